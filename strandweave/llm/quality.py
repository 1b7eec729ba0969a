"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is read as UTF-8 bytes. ``FILTERS`` learned filters, each ``WIDTH`` bytes wide, slide over every
byte; as the input is one of 256 bytes, a filter is a table of weights per offset and byte. Chunks of two blocks of
``BLOCK`` bytes overlap by one block and cover the document. Each filter is max-pooled within a chunk, a hidden layer
reads the pooled values of a chunk, and the document's probability combines the maximum and the mean of every hidden
unit over all chunks. Long texts go through in pieces of ``PIECE`` bytes, so memory is bounded for any length.

Training uses at most ``TRAIN_ROWS`` labelled rows, those of lowest hash among the rows allowed, of at most
``TRAIN_BYTES`` bytes each (a documented bound on the sample; scoring has none). Only the text is an input.

Defined cases: a null or empty text is scored as one chunk of padding; with no labelled rows of one of the classes, all
scores are 0.5; rows with a null label are not learned from; rows that repeat an id count once, and an id with
contradicting labels is left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, map_rows, texts_with

FILTERS, WIDTH, BLOCK, HIDDEN = 24, 5, 128, 16
PIECE = 1 << 16
TRAIN_ROWS, TRAIN_BYTES = 4000, 8192
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.004, 7


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    return {
        "table": draw(WIDTH, 256, FILTERS) * 0.2,
        "bias": np.zeros(FILTERS, np.float32),
        "w1": draw(FILTERS, HIDDEN) * (2 / FILTERS) ** 0.5,
        "b1": np.full(HIDDEN, 0.1, np.float32),
        "w2": draw(2 * HIDDEN) * 0.2,
        "b2": np.zeros(1, np.float32),
    }


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def block_pool(w: dict, data: np.ndarray, blocks: int, places: bool = False):
    """Per block of BLOCK bytes the maximum of each filter over the windows that begin in it. ``data`` holds
    blocks * BLOCK + WIDTH - 1 bytes."""
    n = blocks * BLOCK
    z = w["table"][0].take(data[:n], axis=0)
    for k in range(1, WIDTH):
        z += w["table"][k].take(data[k : k + n], axis=0)
    z = z.reshape(blocks, BLOCK, FILTERS)
    if not places:
        return z.max(axis=1)
    at = z.argmax(axis=1)
    return np.take_along_axis(z, at[:, None, :], 1)[:, 0, :], at


def padded(data: np.ndarray) -> tuple[np.ndarray, int]:
    blocks = max(1, -(-len(data) // BLOCK))
    out = np.zeros(blocks * BLOCK + WIDTH - 1, np.uint8)
    out[: len(data)] = data
    return out, blocks


def pooled_blocks(w: dict, data: np.ndarray) -> np.ndarray:
    """block_pool of a text of any length, in pieces."""
    data, blocks = padded(data)
    step = PIECE // BLOCK
    return np.concatenate([block_pool(w, data[a * BLOCK : (min(blocks, a + step)) * BLOCK + WIDTH - 1], min(blocks, a + step) - a) for a in range(0, blocks, step)])


def chunk_hidden(w: dict, v: np.ndarray) -> np.ndarray:
    """Hidden values of all chunks (pairs of neighbouring blocks; a lone block is a chunk)."""
    pair = np.maximum(v[:-1], v[1:]) if len(v) > 1 else v
    return np.maximum(np.maximum(pair + w["bias"], 0) @ w["w1"] + w["b1"], 0)


def score(w: dict | None, text: str | None) -> float:
    """The probability of label 1."""
    if w is None:
        return 0.5
    h = chunk_hidden(w, pooled_blocks(w, as_bytes(text)))
    x = float(np.concatenate([h.max(0), h.mean(0)]) @ w["w2"] + w["b2"][0])
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, x))))


def gradients(w: dict, data: np.ndarray, label: float, g: dict) -> float:
    """Add one document's gradients to ``g``; returns the loss."""
    data, blocks = padded(data)
    v, at = block_pool(w, data, blocks, places=True)
    if blocks > 1:
        right = v[1:] > v[:-1]
        pair = np.where(right, v[1:], v[:-1])
    else:
        right, pair = np.zeros((1, FILTERS), bool), v
    pre = pair + w["bias"]
    u = np.maximum(pre, 0)
    hp = u @ w["w1"] + w["b1"]
    h = np.maximum(hp, 0)
    top = h.argmax(0)
    feats = np.concatenate([h.max(0), h.mean(0)])
    x = float(feats @ w["w2"] + w["b2"][0])
    p = 1 / (1 + np.exp(-min(30.0, max(-30.0, x))))
    d = np.float32(p - label)
    g["w2"] += d * feats
    g["b2"] += d
    dh = np.repeat((d * w["w2"][HIDDEN:] / len(h))[None, :], len(h), 0)
    dh[top, np.arange(HIDDEN)] += d * w["w2"][:HIDDEN]
    dh *= hp > 0
    g["w1"] += u.T @ dh
    g["b1"] += dh.sum(0)
    du = (dh @ w["w1"].T) * (pre > 0)
    g["bias"] += du.sum(0)
    c, f = np.nonzero(du)
    if len(c):
        block = c + right[c, f] if blocks > 1 else c
        start = block * BLOCK + at[block, f]
        val = du[c, f]
        for k in range(WIDTH):
            np.add.at(g["table"][k], (data[start + k], f), val)
    return -np.log(max(1e-9, p if label else 1 - p))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> dict | None:
    """Adam on the log loss, in a fixed order."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(SEED)
    w = start_weights(rng)
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    data = [as_bytes(t) for t in texts]
    epochs = max(epochs, min(60, -(-epochs * 1500 // len(data))))
    step, total = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            g = {k: np.zeros_like(x) for k, x in w.items()}
            for i in own:
                gradients(w, data[i], labels[i], g)
            step += 1
            rate = RATE * (1 - step / (total + 1)) + 1e-5
            for k in w:
                d = g[k] / len(own)
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def training_rows(docs: DataFrame, text_col: str, id_col: str, labels: DataFrame, label_col: str, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of at most ``most_bytes`` bytes, those whose ids have the lowest hash; ``labels`` holds
    only rows that may be learned from. Every id counts once (see ``labelled``)."""
    # Choose by id first, so that the texts of unchosen rows are never moved.
    few = labelled(docs, text_col, id_col, labels, label_col, most_bytes).orderBy(F.xxhash64("_i"), "_i").limit(rows)
    return texts_with(docs, text_col, id_col, few, most_bytes)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> dict | None:
    got = training_rows(docs, text_col, id_col, labels, label_col, rows, most_bytes)
    return train([t for t, _ in got], [y for _, y in got])


def score_rows(docs: DataFrame, text_col: str, weights: dict | None) -> DataFrame:
    """Struct ``row`` (as given) and struct ``out`` with ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # some 130 kB

    def make():
        w = shipped.value
        return lambda a: [pa.array([score(w, t) for t in a["text"].to_pylist()], pa.float64())]

    return map_rows(docs, {"text": text_col}, make, T.StructType([T.StructField("score", T.DoubleType())]))
