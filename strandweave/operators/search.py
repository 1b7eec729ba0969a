"""Candidate variants: seeded random walks through the graph, guided by read paths.

Walks run in partitions; each draws from a generator seeded by its own number, so the result doesn't depend on how walks
are spread. The graph and the read-path index go along as one object; their size is that of the graph and of the
distinct read paths, and is checked before.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PATH

#: Most distinct read paths that are sent to the workers.
MOST_PATHS = 2_000_000

Step = tuple[str, bool]


@dataclass
class Settings:
    force_circular: bool = False
    uni_chromosome: bool = False
    decay: float = 20.0
    differ: float = 1.0
    inertia: float = 1.0
    longest_alignment: int = 100_000
    longest_walk: int | None = None
    similarity: float = 0.85
    start: str = "random"
    seed: int = 12345


@dataclass
class World:
    """What a walk sees. A step is the number ``2 * contig + strand`` in ``flat``, which holds the read paths end to end, those of
    most reads first; ``off`` has their bounds and ``n`` their reads."""

    names: list[str]
    lens: dict[str, int]
    covs: dict[str, float]
    links: dict[Step, dict[Step, int]]
    flat: np.ndarray
    off: np.ndarray
    n: np.ndarray
    index: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.n)

    def key(self, codes: np.ndarray) -> bytes:
        """Bytes that sort as the steps do. No step is all ones."""
        return codes.astype(">u2" if len(self.names) < 1 << 14 else ">u4").tobytes()

    def keys(self, flat: np.ndarray, off: np.ndarray) -> list[bytes]:
        whole, wide = self.key(flat), len(self.key(flat[:1]))
        bounds = (off * wide).tolist()
        return [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def codes(self, path) -> np.ndarray:
        if "numbers" not in self.index:
            self.index["numbers"] = {name: i for i, name in enumerate(self.names)}
        numbers = self.index["numbers"]
        return np.array([2 * numbers[n] + e for n, e in path], np.int64)

    def steps(self, codes: np.ndarray) -> list[Step]:
        return [(self.names[c >> 1], bool(c & 1)) for c in codes.tolist()]

    def strand(self, i: int, forward: bool) -> list[Step]:
        p = self.flat[self.off[i] : self.off[i + 1]]
        return self.steps(p if forward else p[::-1] ^ 1)

    def build(self) -> World:
        """Both strands of all paths in order of their steps, and a 64-bit hash of what follows from each of their places."""
        if "keys" in self.index:
            return self
        size = np.diff(self.off)
        both = np.concatenate([self.flat, self.flat[::-1] ^ 1])
        size, n = np.concatenate([size, size[::-1]]), np.concatenate([self.n, self.n[::-1]])
        start = np.cumsum(size) - size
        keys = np.array(self.keys(both, np.r_[start, len(both)]), object)
        order = np.argsort(keys, kind="stable")
        keys = keys[order].tolist()
        size, start = size[order], start[order]
        off = np.r_[0, np.cumsum(size)]
        kind = np.int32 if len(both) < 1 << 31 else np.int64
        places = np.arange(len(both), dtype=kind)
        places += np.repeat((start - off[:-1]).astype(kind), size)
        flat = both[places]
        del both, places
        rest, now, at = np.zeros(len(flat), np.uint64), np.zeros(len(size), np.uint64), off[1:] - 1
        live = np.flatnonzero(size > 0)
        while len(live):  # one step from the end of every strand at a time
            x = (now[live] ^ (flat[at[live]].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            now[live] = rest[at[live]] = x ^ (x >> np.uint64(32))
            at[live] -= 1
            live = live[at[live] >= off[live]]
        self.index |= {"keys": keys, "flat": flat, "off": off, "n": n[order].astype(float), "rest": rest}
        return self

    def starting(self, codes: np.ndarray) -> tuple[int, int]:
        """The run of strands that begin with these steps and go on."""
        key, keys = self.key(codes), self.index["keys"]
        low = bisect_right(keys, key)
        return low, bisect_left(keys, key + b"\xff" * 4, low)

    def holding(self, codes: np.ndarray) -> np.ndarray:
        """Places of ``index["flat"]`` where these steps stand within a strand, neither first nor last."""
        flat, off = self.index["flat"], self.index["off"]
        at = np.flatnonzero(flat[: max(0, len(flat) - len(codes))] == codes[0])
        for k in range(1, len(codes)):
            at = at[flat[at + k] == codes[k]]
        owner = np.searchsorted(off, at, "right") - 1
        return at[(at > off[owner]) & (at + len(codes) < off[owner + 1])]

    def pairs(self) -> set:
        """Neighbour pairs of the read paths, on either strand."""
        if "pairs" not in self.index:
            a = np.arange(len(self.flat) - 1)
            a = a[np.searchsorted(self.off, a, "right") == np.searchsorted(self.off, a + 1, "right")]
            self.index["pairs"] = {both_ways(*self.steps(p)) for p in np.unique(np.stack([self.flat[a], self.flat[a + 1]], 1), axis=0)}
        return self.index["pairs"]

    def closes(self, p: list[Step]) -> bool:
        return (p[0][0], not p[0][1]) in self.links.get(p[-1], {})


def both_ways(a: Step, b: Step) -> frozenset:
    return frozenset({(a, b), ((b[0], not b[1]), (a[0], not a[1]))})


def world(segments: DataFrame, links: DataFrame, counts: DataFrame) -> World:
    """The paths come as numbers in Arrow columns; neither here nor in the workers is there an object for each step."""
    lens, covs = {}, {}
    for r in segments.select("name", "len", "cov").collect():
        lens[r["name"]], covs[r["name"]] = r["len"], max(r["cov"] or 0, 1e-8)
    linked: dict = defaultdict(dict)
    for r in links.select("v1", "e1", "v2", "e2", "overlap").collect():
        linked[r["v1"], r["e1"]][r["v2"], r["e2"]] = r["overlap"]
    spark = counts.sparkSession
    used = {r[0] for r in counts.select(F.explode("path.n")).distinct().collect()}
    names = sorted(used | set(lens) | {n for k, v in linked.items() for n, _ in (k, *v)})
    sent = spark.sparkContext.broadcast(names)

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(sent.value, pa.string())
        for b in batches:
            steps = b.column(0).flatten()
            codes = pc.add(pc.multiply(pc.index_in(steps.field(0).cast(pa.string()), value_set=known), 2), steps.field(1).cast(pa.int32())).cast(pa.int32())
            bounds = pa.array(np.r_[0, np.cumsum(b.column(0).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, codes), b.column(1)], names=["path", "n"])

    if (many := counts.count()) > MOST_PATHS:
        raise ValueError(f"{many} distinct read paths; raise the least count of reads for a path")
    got = counts.select("path", F.col("n").cast("long").alias("n")).mapInArrow(number, "path array<int>, n long").toArrow().combine_chunks()
    column = got.column("path").combine_chunks() if got.num_rows else None
    flat = column.flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, np.int32)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    n = got.column("n").to_numpy()
    del got, column
    w = World(names, lens, covs, {k: dict(sorted(v.items())) for k, v in linked.items()}, flat, np.r_[0, np.cumsum(size)], n)
    keys, most = w.keys(w.flat, w.off), (-n).tolist()
    order = np.array(sorted(range(len(keys)), key=lambda i: (most[i], keys[i])), np.int64)
    start, size = w.off[:-1][order], size[order]
    w.off = np.r_[0, np.cumsum(size)]
    w.flat, w.n = flat[np.arange(len(flat)) + np.repeat(start - w.off[:-1], size)].astype(np.int32), n[order]
    return w


def reverse(p: list[Step]) -> list[Step]:
    return [(n, not e) for n, e in reversed(p)]


def copy_ratio(w: World, path: list[Step], more: list[Step]) -> float:
    """How much likelier the contigs' depths are with the extension than without it (1 for a new contig)."""
    now = Counter(n for n, _ in path)
    new = now + Counter(n for n, _ in more)
    if set(new) - set(now):
        return math.inf

    def like(copies: Counter) -> float:
        total = sum(w.lens[n] * c for n, c in copies.items())
        return sum(w.lens[n] * w.covs[n] * math.log(w.lens[n] * c / total) for n, c in copies.items())

    gain = like(new) - like(now)
    return math.inf if gain > 700 else math.exp(max(-700.0, gain))


def pull(w: World, path: list[Step], name: str, power: float) -> float:
    """Nearness of a contig's depth to the walk's mean depth for each copy."""
    copies = Counter(n for n, _ in path)
    mean = sum(w.covs[n] * w.lens[n] for n in copies) / max(1, sum(w.lens[n] * c for n, c in copies.items()))
    return math.exp(-abs(math.log(w.covs[name] / max(mean, 1e-8)))) ** power


def extend(w: World, s: Settings, rng: np.random.Generator, path: list[Step]) -> list[Step]:
    """Steps to append, or none: continuations of read paths that overlap the walk's end, the longest overlaps first by
    weight; else the graph's links."""
    codes, held = w.codes(path), w.index
    bases, found = 0, []
    for k in range(1, len(path) + 1):
        if k > 2:
            bases += w.lens[path[-k + 1][0]]
        if bases >= s.longest_alignment:
            break
        low, high = w.starting(codes[-k:])
        if low < high:
            found.append((k, low, high))
    if not found and len(at := w.holding(codes)):
        owner = np.searchsorted(held["off"], at, "right") - 1
        mine = owner[int(rng.integers(len(at)))]
        first = at[owner == mine].min()
        return w.steps(held["flat"][first + len(path) : held["off"][mine + 1]])
    if found:
        places, weights = options(w, s, found)
        heads = held["flat"][places] >> 1
        more = lambda i: w.steps(held["flat"][places[i] : held["off"][np.searchsorted(held["off"], places[i], "right")]])
    else:
        linked = sorted(w.links.get(path[-1], {}))
        if not linked:
            return []
        heads, weights = w.codes((n, not e) for n, e in linked) >> 1, np.ones(len(linked))
        more = lambda i: [(linked[i][0], not linked[i][1])]
    if s.uni_chromosome:
        ratios = [copy_ratio(w, path, more(i)) for i in range(len(weights))]
        by_depth = np.array([1.0 if math.isinf(r) else r / (1 + r) for r in ratios])
    else:
        kinds, which = np.unique(heads, return_inverse=True)
        by_depth = np.array([pull(w, path, w.names[c], s.inertia) for c in kinds.tolist()])[which]
    p = weights * by_depth + 1e-300
    return more(int(rng.choice(len(p), p=p / p.sum())))


def options(w: World, s: Settings, found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``index["flat"]`` from which distinct continuations go on to their strand's end, and their weights. ``found`` has
    the runs of strands that overlap the walk's end by k steps; of equal continuations the greatest weight counts."""
    places, weights = [], []
    for k, low, high in found:
        n = w.index["n"][low:high] ** s.differ
        places.append(w.index["off"][low:high] + k)
        weights.append(n / n.sum() * s.decay ** (k - found[-1][0]))
    places, weights = np.concatenate(places), np.concatenate(weights)
    order = np.lexsort((-weights, w.index["rest"][places]))
    rest = w.index["rest"][places[order]]
    order = order[np.r_[True, rest[1:] != rest[:-1]]]
    return places[order], weights[order]


def walk(w: World, s: Settings, number: int) -> list[Step]:
    rng = np.random.default_rng([s.seed, number])
    at = number % len(w) if s.start == "numerate" else int(rng.integers(len(w)))
    path = w.strand(at, bool(rng.integers(2)))
    turned = False
    # Ends with probability 1: where no contig is new, every step must pass a draw.
    while s.longest_walk is None or len(path) < s.longest_walk:
        more = extend(w, s, rng, path)
        while more:  # take the longest part of it that the contigs' depths allow
            r = copy_ratio(w, path, more)
            if math.isinf(r) or rng.random() < r / (1 + r):
                break
            more = more[:-1]
        if more and all(b[0] in w.lens for b in more):
            path += more
        elif not turned:
            path, turned = reverse(path), True
        else:
            break
    return path


def unit(path: list[Step]) -> list[Step]:
    """The smallest repeating unit."""
    for d in range(1, len(path) + 1):
        if all(path[i] == path[i % d] for i in range(len(path))):
            return path[:d]
    return path


def canonical_ring(path: list[Step]) -> list[Step]:
    both = [path, reverse(path)]
    return min(p[i:] + p[:i] for p in both for i in range(len(p)))


def split_units(w: World, path: list[Step], similarity: float, seen: set) -> list[list[Step]]:
    """A circular walk that is several copies of nearly one genome, cut into its copies; none of the neighbour pairs that
    reads have seen may get lost."""
    if len(path) < 4:
        return [path]
    copies = Counter(n for n, _ in path)
    total = sum(c * w.lens[n] for n, c in copies.items())
    for many in sorted({c for c in copies.values() if c > 1}, reverse=True):
        share = sum(c * w.lens[n] for n, c in copies.items() if c % many == 0) / total
        starts = [n for n, c in copies.items() if c == many]
        if share < similarity or not starts:
            continue
        first = max(starts, key=lambda n: (w.lens[n], n))
        cuts = [i for i, (n, _) in enumerate(path) if n == first]
        parts = [(path + path)[a : a + (b - a) % len(path) or len(path)] for a, b in zip(cuts, cuts[1:] + cuts[:1], strict=True)]
        common = sum(min(Counter(n for n, _ in p)[n] for p in parts) * w.lens[n] for n in copies)
        pairs = lambda p: {both_ways(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True)}
        if many * common / total > similarity and all(w.closes(p) for p in parts) and (pairs(path) & seen) <= set().union(*map(pairs, parts)):
            return parts
    return [path]


def candidates(spark: SparkSession, w: World, s: Settings, walks: int, first: int = 0) -> DataFrame:
    """path, circular, n, first: distinct valid results of walks ``first`` to ``first + walks``."""
    # A dictionary, as broadcasts name classes by their module and workers need not have it. Its size is checked in ``world``.
    sent_settings, shipped = s, spark.sparkContext.broadcast({k: v for k, v in vars(w).items() if k != "index"} | {"index": {}})
    go, make = walk, World

    def run(batches):
        import pandas as pd

        sent = make(**shipped.value).build()  # one index for all tasks of a worker
        seen = sent.pairs()
        for pdf in batches:
            out = []
            for number in pdf["id"]:
                path = unit(go(sent, sent_settings, int(number)))
                ring = sent.closes(path)
                parts = split_units(sent, path, sent_settings.similarity, seen) if ring else [path]
                for p in parts:
                    if sent_settings.force_circular and not ring or sent_settings.uni_chromosome and {n for n, _ in p} != set(sent.lens):
                        continue
                    p = canonical_ring(p) if ring else min(p, reverse(p))
                    out.append(([{"n": n, "e": e} for n, e in p], ring, int(number)))
            yield pd.DataFrame(out, columns=["path", "circular", "number"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("path", PATH), T.StructField("circular", T.BooleanType()), T.StructField("number", T.LongType())])
    parts = max(1, min(walks, spark.sparkContext.defaultParallelism))
    got = spark.range(first, first + walks, 1, parts).mapInPandas(run, schema)
    return got.groupBy("path", "circular").agg(F.count("*").alias("n"), F.min("number").alias("first"))


def search(spark: SparkSession, segments: DataFrame, links: DataFrame, counts: DataFrame, s: Settings, least: int = 500, most: int = 10_000, most_walks: int = 30_000, most_unique: int = 200, max_uncover: float = 0.001) -> DataFrame:
    """Rounds of walks until the variants found cover the read paths, the rest no longer shrinks, or a limit is met.

    After N walks that leave a share rho of reads uncovered, the next round is sized so that the chance to miss one of
    the read paths falls to a half.
    """
    from .graph import checkpointed

    w = world(segments, links, counts)
    if not len(w):
        raise ValueError("no read path to start from")
    found, done, goal, same, last = None, 0, least, 0, None
    reads = int(w.n.sum())
    wanted, held, counted = w.keys(w.flat, w.off), np.zeros(len(w), bool), set()
    lengths = np.unique(np.diff(w.off)).tolist()
    while done < min(goal, most_walks):
        n = min(goal, most_walks) - done
        new = candidates(spark, w, s, n, done)
        done += n
        both = new if found is None else found.unionByName(new)
        found = checkpointed(both.groupBy("path", "circular").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
        rows = found.orderBy("first").limit(most_unique + 1).collect()
        runs: set[bytes] = set()
        for r in rows:  # at most ``most_unique`` + 1, each looked at once
            if r["first"] in counted:
                continue
            counted.add(r["first"])
            p = [(x["n"], x["e"]) for x in r["path"]]
            ext = p * (2 + -(-lengths[-1] // len(p))) if r["circular"] else p
            for strand in (ext, reverse(ext)):
                key = w.key(w.codes(strand))
                wide = len(key) // len(strand)
                runs |= {key[i * wide : (i + k) * wide] for k in lengths for i in range(len(strand) - k + 1)}
        held[[i for i in np.flatnonzero(~held).tolist() if wanted[i] in runs]] = True
        rho = int(w.n[~held].sum()) / reads
        same = same + 1 if rho == last else 0
        last = rho
        valid = sum(r["n"] for r in rows)
        if rho <= max_uncover or same >= 4 or len(rows) > most_unique or valid >= most or done >= most_walks:
            break
        goal = done + max(1, math.ceil(done * math.log(0.5 / len(w)) / math.log(rho) - done)) if rho < 1 else done * 2
    return found
