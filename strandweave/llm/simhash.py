"""SimHash near-duplicates: fingerprints linked by vantage-point trees.

A fingerprint has a bit for each of 64 places, set where over half of the hashes of the text's shingles have it.
Texts of equal fingerprint form a class, and only distinct fingerprints are compared. A vantage-point tree deals them
into shards: at each level a fingerprint falls into the ring of its Hamming distance to the node's vantage
point, and each ring is a node of the next level with a vantage point of its own. By the triangle inequality two
fingerprints within ``radius`` lie in rings at most ``radius`` apart, so a fingerprint belongs to one shard
and queries only the shards across ring boundaries that the bound leaves (of two neighbouring shards one
queries the other). A shard is searched by the same rule, with vantage points of its own, down to small blocks that
are compared bit by bit, so the pairs are exact. Large shards are split into blocks of bounded size. A
task gives back a spanning forest of its links and never all pairs; the forests' components are joined in Spark.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; texts
of one or two words have one shingle; repeated rows share a class; a null id takes part but never names a
component (a component of null ids only has a null name); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of the sample from which vantage points are drawn.
SAMPLE = 4000
#: A further level of the tree for each factor LEVEL_FACTOR of fingerprints over SHARD_ROWS. A level deals the
#: fingerprints into some 20 rings (the fullest holds a tenth) and lets each query up to five of them.
SHARD_ROWS, LEVEL_FACTOR = 300, 40
#: Shards of more rows than this are split into blocks.
BLOCK_DATA, BLOCK_OTHERS = 40_000, 80_000


def hashes_of(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False))
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - size + 1)


def bits_of(hashes: np.ndarray, ties: bool = False, step: int = 1 << 16) -> int:
    """The signed 64-bit number of the bits set in over half of the hashes; with ``ties``, odd places that are
    set in just half count too."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    more = counts * 2 + (np.arange(64) & 1 if ties and len(hashes) else 0) > len(hashes)
    return int(np.packbits(more, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    return bits_of(hashes_of(text, size))


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """Struct ``row`` (as given) and struct ``out`` with ``fp``."""

    def make():
        return lambda a: [pa.array(map(fingerprint, a["text"].to_pylist()), pa.int64())]

    return map_rows(docs, {"text": text_col}, make, T.StructType([T.StructField("fp", T.LongType())]))


def differing(x: np.ndarray) -> np.ndarray:
    """Set bits; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def distance(x: np.ndarray, v) -> np.ndarray:
    return differing(x ^ v).astype(np.int64)


def vantage_points(sample: np.ndarray, levels: int) -> list[np.ndarray]:
    """For each level 65 vantage points (one for each ring of its parent), those of a sample that spread it most."""
    sample = np.sort(sample)
    few = sample[:: max(1, len(sample) // 500)]
    spread = np.array([distance(few, v).var() for v in few])
    best = few[np.argsort(-spread, kind="stable")]
    need = 65 * levels
    best = np.concatenate([best] * -(-need // len(best)))[:need] if len(best) else np.zeros(need, np.int64)
    return [best[i::levels][:65] for i in range(levels)]


def shards_of(fps: np.ndarray, points: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (place in fps, shard, whether it is the fingerprint's own shard): its own shard and those it must query.

    Of two shards that touch, the one whose ring comes first in the first level where they differ queries the other.
    """
    at, shard, own = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    ring = np.zeros(len(fps), np.int64)
    for level, vs in enumerate(points):
        v = vs[ring] if level else np.full(len(at), vs[0])
        d = distance(fps[at], v)
        parts = []
        for off in range(-radius, radius + 1):
            go = (d + off >= 0) & (d + off <= 64) & (~own | (off >= 0))
            parts.append((at[go], shard[go] * 65 + d[go] + off, own[go] & (off == 0), (d + off)[go]))
        at, shard, own, ring = (np.concatenate(p) for p in zip(*parts, strict=True))
    return at, shard, own


class Forest:
    """Union-find over the data of a task, by labels; the label is the place of the least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if root:
            move = np.arange(len(self.label))
            for x in root:
                move[x] = find(x)
            self.label = move[self.label]


def search(data: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between data and others within ``radius`` as a spanning forest: arrays a, b of linked fingerprints."""
    forest, found_o, found_d = Forest(len(data)), [], []

    def compare(d: np.ndarray, o: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(d)))
        for a in range(0, len(o), step):
            part = o[a : a + step]
            near = differing(others[part][:, None] ^ data[d][None, :]) <= radius
            rows, cols = np.nonzero(near)
            if not len(rows):
                continue
            first = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
            label = forest.label[d[cols]]
            least = np.minimum.reduceat(label, first)
            spread = np.repeat(least, np.diff(np.r_[first, len(rows)]))
            differ = label != spread
            found_o.append(part[rows[first]])
            found_d.append(least)
            if differ.any():
                pairs = np.unique(np.stack([spread[differ], label[differ]]), axis=1)
                forest.union(pairs[0], pairs[1])

    def walk(d: np.ndarray, o: np.ndarray, depth: int) -> None:
        if not len(d) or not len(o):
            return
        if len(d) * len(o) <= 4_000_000 or depth >= 4:
            compare(d, o)
            return
        v = data[d[len(d) * (2 * depth + 1) // 9]]
        dd, do = distance(data[d], v), distance(others[o], v)
        d = d[np.argsort(dd, kind="stable")]
        bounds = np.searchsorted(np.sort(dd), np.arange(67))
        for k in range(65):
            mine = o[do == k]
            if len(mine):
                walk(d[bounds[max(0, k - radius)] : bounds[min(65, k + radius + 1)]], mine, depth + 1)

    walk(np.arange(len(data)), np.arange(len(others)), 0)
    moved = np.flatnonzero(forest.label != np.arange(len(data)))
    a, b = [data[moved]], [data[forest.label[moved]]]
    if found_o:
        a.append(others[np.concatenate(found_o)])
        b.append(data[forest.label[np.concatenate(found_d)]])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = a != b
    if not keep.any():
        return a[:0], b[:0]
    pairs = np.unique(np.stack([a[keep], b[keep]]), axis=1)
    return pairs[0], pairs[1]


def link(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``: a spanning forest for each part of the search."""
    spark = distinct.sparkSession
    levels = max(1, math.ceil(math.log(max(2.0, count / SHARD_ROWS), LEVEL_FACTOR)))
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    points = vantage_points(sample, levels)
    sent = spark.sparkContext.broadcast(points)

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            at, shard, own = shards_of(fps, sent.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(shard), pa.array(own)], names=["fp", "shard", "own"])

    dealt = distinct.select("fp").mapInArrow(deal, "fp long, shard long, own boolean")
    sizes = dealt.groupBy("shard").agg(F.sum(F.col("own").cast("long")).alias("d"), F.count("*").alias("n"))
    # A shard with no fingerprint of its own has nothing to search. Only shards to be split come to the driver.
    big = {r["shard"]: (-(-r["d"] // BLOCK_DATA), -(-r["n"] // BLOCK_OTHERS)) for r in sizes.filter((F.col("d") > BLOCK_DATA) | (F.col("n") > BLOCK_OTHERS)).collect()}
    blocks = spark.sparkContext.broadcast(big)

    def split(batches):
        """Data go to every task of their block row, others to every task of their block column."""
        for b in batches:
            fps, shard, own = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            many = np.isin(shard, np.fromiter(blocks.value, np.int64, len(blocks.value))) if blocks.value else np.zeros(len(shard), bool)
            few = ~many
            out = [(fps[few], shard[few], np.zeros(few.sum(), np.int32), own[few].astype(np.int8) + 2)]
            for s in np.unique(shard[many]):
                rows, cols = blocks.value[int(s)]
                rows = max(1, rows)
                mine = shard == s
                f, o = fps[mine], own[mine]
                mix = (f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                i, j = (mix % np.uint64(rows)).astype(np.int32), (mix // np.uint64(rows) % np.uint64(cols)).astype(np.int32)
                for c in range(cols):
                    out.append((f[o], np.full(o.sum(), s), i[o] * cols + c, np.ones(o.sum(), np.int8)))
                for r in range(rows):
                    out.append((f, np.full(len(f), s), r * cols + j, np.full(len(f), 2, np.int8)))
            a = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1].astype(np.int64)), pa.array(a[2].astype(np.int32)), pa.array(a[3].astype(np.int8))], names=["fp", "shard", "block", "role"])

    def within(group: pa.Table) -> pa.Table:
        fps, role = group.column("fp").to_numpy(), group.column("role").to_numpy()
        data, others = np.unique(fps[(role & 1) > 0]), np.unique(fps[(role & 2) > 0])
        a, b = search(data, others, radius) if len(data) else (data, data)
        return pa.table({"a": a, "b": b})

    tasks = dealt.select("fp", "shard", "own").mapInArrow(split, "fp long, shard long, block int, role byte")
    return tasks.groupBy("shard", "block").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id (the least id that links reach)."""
    got = fingerprints(docs.select(id_col, text_col), text_col)
    rows = cut(got.select(F.col("row")[id_col].alias("doc_id"), F.col("out.fp").alias("fp")))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(classes, classes.count(), radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(by_class, "fp").select("doc_id", "fp", "component_id")


def hex16(fp):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
