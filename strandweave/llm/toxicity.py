"""Toxicity: a gap-weighted subsequence-kernel support vector machine with Nystroem landmarks.

Strings are compared by the subsequences of three characters that they share, also with gaps: a subsequence that skips
g characters counts ``GAP ** g``, up to a span of ``SPAN`` characters, so an insult with inserted or lost
characters stays close to the insult. The blank before and after a word counts as a character. A kernel is
scaled by the norm of a string of that length without repeats.

A Nystroem map sends a string to its kernel values with ``LANDMARKS`` landmark strings times the inverse root of the
landmarks' own kernel; a linear machine with squared hinge loss is trained on the mapped words. As the
kernel is an inner product of subsequence counts, map and machine fold into one weight for each subsequence, and
a word's value is a sum of table entries. Labels belong to whole texts, so the machine learns by turns which words
of a toxic text are to blame (multiple-instance learning); all words of the other texts are blameless. A
text's probability is a logistic function of the values of its ``TOP`` most toxic units.

Units are words; letters that stand alone in a row are drawn together, and words of over ``LONG`` characters are read
in overlapping windows. Whole texts are read, in pieces of ``PIECE`` characters that are cut at blanks.

Training uses at most ``TRAIN_ROWS`` labelled rows of each class, those of lowest hash, of at most ``TRAIN_BYTES`` bytes
(a documented bound on the sample; scoring has none). Of the words to blame it learns from at most ``GUILTY_WORDS`` and
as many forms of them with an inserted character: those to blame in most texts come first. Only the text is an input.

Defined cases: null and empty texts have no unit and get the probability of the least values; with no labelled rows of one
of the classes all scores are 0; rows with a null label are not learned from; rows that repeat an id count once, and an
id with contradicting labels is left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, map_rows, texts_with

GAP, SPAN = 0.5, 6
SYMBOLS = 64
LANDMARKS = 256
LONG, STEP = 24, 8
PIECE = 1 << 18
TRAIN_ROWS, TRAIN_BYTES = 1500, 4096
CLEAN_WORDS, HARD_WORDS, GUILTY_WORDS, SHARED = 12_000, 2000, 6000, 8
SPOILT = 4
TURNS, PENALTY, SEED = 6, 6.0, 11
#: A text is judged by its most toxic units, of values between these bounds.
TOP, NOTHING, MOST = 4, -1.5, 2.0


def gaps() -> list[tuple[int, int, float]]:
    """Offsets of the second and third character and the weight."""
    return [(j, k, GAP ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]


def symbol_table(texts: list[str]) -> np.ndarray:
    """Code point to symbol: 0 for blanks, the commonest characters from 1, the rest share the last."""
    seen = Counter(c for t in texts for c in t.lower() if not c.isspace())
    out = np.full(0x10000, SYMBOLS - 1, np.int32)
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2]):
        if ord(c) < 0x10000:
            out[ord(c)] = i + 1
    for b in range(0x10000):
        if chr(b).isspace():
            out[b] = 0
    return out


def draw_together(text: str) -> str:
    return re.sub(r"(?<!\S)(\S) (?=\S(?!\S))", r"\1", text.lower())


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(codes, 0xFFFF)]


def norm_of(length: np.ndarray | int) -> np.ndarray:
    """Norm of a unit of so many characters, blanks included, without repeats."""
    total = np.zeros_like(np.asarray(length, float))
    for _, k, w in gaps():
        total += np.maximum(np.asarray(length) - k, 0) * w * w
    return np.sqrt(np.maximum(total, 1))


def units(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive; both blanks included) of every unit of a symbol string."""
    blank = np.flatnonzero(s == 0)
    a, b = blank[:-1], blank[1:]
    word = b - a > 1
    a, b = a[word], b[word] + 1
    big = b - a > LONG
    if big.any():
        more_a, more_b = [], []
        for x, y in zip(a[big], b[big], strict=True):
            at = np.arange(x, y - STEP, STEP)
            more_a.append(at)
            more_b.append(np.minimum(at + 2 * STEP, y))
        a, b = np.concatenate([a[~big], *more_a]), np.concatenate([b[~big], *more_b])
    return a, b


def unit_values(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Machine values of all units: sums of subsequence weights over the norm, without the offset."""
    a, b = units(s)
    if not len(a):
        return np.zeros(0)
    n = len(s)
    blanks = np.cumsum(s == 0)
    by_end = np.zeros(n + 1)
    here = np.zeros(n)
    # Every subsequence lies in the words whose blanks enclose it; values are gathered at its first character.
    tails = {k: (blanks[k - 1 : n - 1] == blanks[: n - k]) for k in range(2, SPAN) if n > k}
    s1, s2 = s * (SYMBOLS * SYMBOLS), s * SYMBOLS
    for j, k, w in gaps():
        if n <= k:
            continue
        idx = s1[: n - k] + s2[j : n - k + j] + s[k:]
        here[: n - k] += w * weights[idx] * tails[k]
    np.cumsum(here, out=by_end[1:])
    total = by_end[b - 1] - by_end[a]
    return total / norm_of(b - a)


def terms(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first character, key and weight of every subsequence within a word of a symbol string."""
    n = len(s)
    blanks = np.cumsum(s == 0)
    at, key, weight = [], [], []
    for j, k, w in gaps():
        if n > k:
            p = np.flatnonzero(blanks[k - 1 : n - 1] == blanks[: n - k])
            at.append(p)
            key.append((s[p] * SYMBOLS + s[p + j]) * SYMBOLS + s[p + k])
            weight.append(np.full(len(p), w, np.float32))
    return np.concatenate(at), np.concatenate(key), np.concatenate(weight)


def word_terms(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, key and scaled weight of every subsequence of the words (each without blanks)."""
    s = symbols(" ".join(words), table)
    at, key, weight = terms(s)
    sizes = np.array([len(w) for w in words]) + 1
    word = np.repeat(np.arange(len(words)), sizes)[np.minimum(at, sizes.sum() - 1)]
    return word, key, (weight / norm_of(sizes + 1)[word]).astype(np.float32)


def mapped(words: list[str], table: np.ndarray, place: np.ndarray, to_map: np.ndarray, step: int = 1000) -> np.ndarray:
    """Nystroem features of the words; ``place`` is the row of ``to_map`` for a key, or -1."""
    out = np.zeros((len(words), to_map.shape[1]), np.float32)
    for a in range(0, len(words), step):
        word, key, weight = word_terms(words[a : a + step], table)
        row = place[key]
        used = np.flatnonzero(row >= 0)
        used = used[np.argsort(word[used], kind="stable")]
        if len(used):
            first = np.flatnonzero(np.r_[True, np.diff(word[used]) > 0])
            out[a + word[used[first]]] = np.add.reduceat(to_map[row[used]] * weight[used][:, None], first, axis=0)
    return out


def word_values(words: list[str], table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    word, key, weight = word_terms(words, table)
    return np.bincount(word, weights[key] * weight, minlength=len(words))


def spoilt(word: str) -> list[str]:
    """The word with one foreign character inserted at each inner place; words of under ``SPOILT`` characters have none."""
    return [word[:i] + "\uffff" + word[i:] for i in range(1, len(word))] if len(word) >= SPOILT else []


def words_in(text: str) -> list[str]:
    out = []
    for w in draw_together(text).split():
        if len(w) + 2 > LONG:
            out += [w[i : i + 2 * STEP] for i in range(0, max(1, len(w) - STEP), STEP)]
        else:
            out.append(w)
    return out


def hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights (offset last) of the squared-hinge machine, by Newton's method."""
    x, y, c = np.hstack([x, np.ones((len(x), 1), x.dtype)]), y.astype(np.float32), c.astype(np.float32)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(20):
        on = 1 - y * (x @ w.astype(np.float32)) > 0
        xa = x[on] * c[on][:, None]
        new = np.linalg.solve(ridge + xa.T @ x[on], xa.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(texts: list[str], labels: list[int]) -> dict | None:
    if len(set(labels)) < 2:
        return None
    table = symbol_table(texts)
    own = [sorted(set(words_in(t))) for t in texts]
    pos, neg = Counter(), Counter()
    for ws, y in zip(own, labels, strict=True):
        (pos if y else neg).update(ws)
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    blame = lambda w: pos[w] * math.log(((pos[w] + 0.1) / n_pos) / ((neg[w] + 0.5) / n_neg))
    # A word may be to blame where toxic texts have it far more often; labels have errors.
    free = {w for w in pos if pos[w] * n_neg > 12 * neg[w] * n_pos}
    half = LANDMARKS // 2
    marks = sorted(free, key=lambda w: (-blame(w), w))[:half]
    rest = sorted((w for w in neg if w not in free), key=lambda w: (-neg[w], w))
    rng = np.random.default_rng(SEED)
    marks += rest[: half // 2] + [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), half), replace=False)) if i >= half // 2][:half]
    # Kernel values by way of the subsequences that landmarks have.
    word, key, weight = word_terms(marks, table)
    keys = np.unique(key)
    place = np.full(SYMBOLS**3, -1, np.int32)
    place[keys] = np.arange(len(keys))
    z = np.zeros((len(marks), len(keys)), np.float32)
    np.add.at(z, (word, place[key]), weight)
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    good = values > 1e-6 * values.max()
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    to_map = (z.T @ root).astype(np.float32)
    # Blameless words to learn from: the commonest, some of the rest, and each turn those that the machine takes for toxic.
    clean = rest[: CLEAN_WORDS // 2] + [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), CLEAN_WORDS), replace=False)) if i >= CLEAN_WORDS // 2][: CLEAN_WORDS // 2]
    inside = set(clean)
    x_clean = mapped(clean, table, place, to_map)
    docs = [ws for ws, y in zip(own, labels, strict=True) if y and ws]
    # At first to blame: in each toxic text the word that speaks most for toxicity, and words that many of them share.
    guilty = Counter()
    for d in docs:
        top = max(d, key=lambda w: (blame(w) if w in free else -1.0, w))
        guilty.update({top} | {w for w in d if w in free and pos[w] >= max(SHARED, 0.03 * n_pos)})
    weights, offset = np.zeros(SYMBOLS**3, np.float32), 0.0
    bounds = np.cumsum([0, *map(len, docs)])
    flat = [w for d in docs for w in d]
    for _ in range(TURNS):
        names = sorted((w for w in guilty if w in free), key=lambda w: (-guilty[w], -blame(w), w))[:GUILTY_WORDS]
        if not names:
            return None
        bad = [(v, 0.3 * min(guilty[w], 50)) for w in names for v in spoilt(w)][:GUILTY_WORDS] + [(w, float(min(guilty[w], 50))) for w in names]
        x = np.vstack([mapped([v for v, _ in bad], table, place, to_map), x_clean])
        y = np.concatenate([np.ones(len(bad)), -np.ones(len(x_clean))])
        c = PENALTY * np.concatenate([np.array([c for _, c in bad]), np.ones(len(x_clean))])
        c[: len(bad)] *= max(1.0, 0.25 * len(x_clean) / c[: len(bad)].sum())
        machine = hinge(x, y, c)
        weights[keys], offset = to_map @ machine[:-1], float(machine[-1])
        found = word_values(flat, table, weights) + offset
        guilty = Counter()
        for d, a, b in zip(docs, bounds[:-1], bounds[1:], strict=True):
            own_values = found[a:b]
            top = int(own_values.argmax())
            guilty.update({d[top]} | {d[i] for i in np.flatnonzero(own_values > 0) if d[i] in free})
        worst = word_values(rest, table, weights) + offset
        more = [rest[i] for i in np.argsort(-worst, kind="stable")[:HARD_WORDS] if worst[i] > -1 and rest[i] not in inside]
        if more:
            inside |= set(more)
            x_clean = np.vstack([x_clean, mapped(more, table, place, to_map)])
    w = {"table": table, "weights": weights, "offset": offset}
    w["slope"] = logistic(np.array([top_values(w, t) for t in texts]), np.array(labels, float))
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (offset last) of the labels' probability, by Newton's method with Platt's softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = 0.02 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ w)
        step *= min(1.0, 2 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def pieces(text: str):
    """A text in parts of about PIECE characters, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def top_values(w: dict, text: str | None) -> np.ndarray:
    """Values of the ``TOP`` most toxic units, falling, held between NOTHING and MOST."""
    best = np.full(TOP, NOTHING)
    for part in pieces(text or ""):
        got = unit_values(symbols(draw_together(part), w["table"]), w["weights"])
        if len(got) > TOP:
            got = np.partition(got, len(got) - TOP)[-TOP:]
        best = np.sort(np.concatenate([best, got + w["offset"]]))[::-1][:TOP]
    return np.clip(best, NOTHING, MOST)


def score(w: dict | None, text: str | None) -> float:
    """The probability of label 1."""
    if w is None:
        return 0.0
    x = float(top_values(w, text) @ w["slope"][:-1] + w["slope"][-1])
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def training_rows(docs: DataFrame, text_col: str, id_col: str, labels: DataFrame, label_col: str, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of each class, those whose ids have the lowest hash; ``labels`` holds only rows that
    may be learned from. Every id counts once (see ``labelled``)."""
    ids = labelled(docs, text_col, id_col, labels, label_col, most_bytes)
    few = [ids.filter(F.col("_y") == y).orderBy(F.xxhash64("_i"), "_i").limit(rows) for y in (0, 1)]
    return texts_with(docs, text_col, id_col, few[0].union(few[1]), most_bytes)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> dict | None:
    got = training_rows(docs, text_col, id_col, labels, label_col, rows, most_bytes)
    return train([t for t, _ in got], [y for _, y in got])


def score_rows(docs: DataFrame, text_col: str, weights: dict | None) -> DataFrame:
    """Struct ``row`` (as given) and struct ``out`` with ``score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # some 1.5 MB

    def make():
        w = shipped.value
        return lambda a: [pa.array([score(w, t) for t in a["text"].to_pylist()], pa.float64())]

    return map_rows(docs, {"text": text_col}, make, T.StructType([T.StructField("score", T.DoubleType())]))
