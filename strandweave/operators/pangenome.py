"""Pangenome: co-linear blocks of variants, division of coverage, and the merged graph.

A block is a run of cells; a cell names one step of each variant that the block aligns.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ways to combine repeated copies that are tried for one contig.
MOST_COMBINATIONS = 1000


def index(variants: DataFrame) -> DataFrame:
    """cid, vid, n, e, next_vid, prev_vid: neighbours wrap around in circular variants."""
    rows = variants.select("cid", "circular", F.size("path").alias("len"), F.posexplode("path").alias("vid", "s")).select("cid", "circular", "len", "vid", F.col("s.n").alias("n"), F.col("s.e").alias("e"))
    at = lambda off: F.pmod(F.col("vid") + off, F.col("len"))
    inside = lambda off: (F.col("vid") + off >= 0) & (F.col("vid") + off < F.col("len"))
    return rows.select("cid", "vid", "n", "e", F.when(F.col("circular") | inside(1), at(1)).alias("next_vid"), F.when(F.col("circular") | inside(-1), at(-1)).alias("prev_vid"))


def copy_distribution(variants: DataFrame) -> DataFrame:
    """name, max_copies, n_variants."""
    per = variants.select("cid", F.explode("path").alias("s")).groupBy(F.col("s.n").alias("name"), "cid").agg(F.count("*").alias("c"))
    return per.groupBy("name").agg(F.max("c").alias("max_copies"), F.count("*").alias("n_variants"))


def combinations(sizes: list[int], most: int = MOST_COMBINATIONS, seed: int = 12345) -> list[tuple[int, ...]]:
    """Index combinations of lists of these sizes: all of them, or ``most`` different seeded draws where there are more."""
    if math.prod(sizes) <= most:
        return list(product(*[range(n) for n in sizes]))
    rng = np.random.default_rng(seed)
    out: dict[tuple[int, ...], None] = {}
    while len(out) < most:
        out[tuple(int(rng.integers(n)) for n in sizes)] = None
    return list(out)


class Blocks:
    """Greedy search for co-linear blocks in a handful of best variants."""

    def __init__(self, paths: list[list[tuple[str, bool]]], circular: list[bool], props: list[float], lengths: dict[str, int]):
        self.paths, self.circular, self.props, self.lengths = paths, circular, props, lengths
        self.free = {(p, v) for p, path in enumerate(paths) for v in range(len(path))}

    def step(self, p: int, v: int, by: int) -> int | None:
        n = len(self.paths[p])
        if self.circular[p]:
            return (v + by) % n
        return v + by if 0 <= v + by < n else None

    def grow(self, start: list[tuple[int, int]]) -> list[list[tuple[int, int, bool]]]:
        """Extend aligned steps both ways while all variants step to the same contig end."""
        used = set(start)
        block = [[(p, v, True) for p, v in start]]
        same = {(p): self.paths[p][v][1] for p, v in start}
        for onward in (True, False):
            now = list(start)
            while True:
                new, seen = [], set()
                for p, v in now:
                    w = self.step(p, v, 1 if same[p] == onward else -1)
                    if w is None or (p, w) in used or (p, w) not in self.free:
                        break
                    name, e = self.paths[p][w]
                    seen.add((name, e == same[p]))
                    new.append((p, w))
                if len(new) < len(now) or len(seen) > 1 or len(set(new)) < len(new):
                    break
                used |= set(new)
                e = next(iter(seen))[1]
                cell = [(p, w, e) for p, w in new]
                block = [*block, cell] if onward else [cell, *block]
                now = new
        return block

    def candidates(self, name: str) -> list[list]:
        places = defaultdict(list)
        for p, v in sorted(self.free):
            if self.paths[p][v][0] == name:
                places[p].append((p, v))
        out = {}
        held = [places[p] for p in sorted(places)]
        for chosen in combinations([len(x) for x in held]):
            b = self.grow([x[i] for x, i in zip(held, chosen, strict=True)])
            out[tuple(tuple(c) for c in b)] = b
        return list(out.values())

    def weight(self, block) -> float:
        return sum(self.lengths.get(self.paths[c[0][0]][c[0][1]][0], 1) for c in block) * sum(self.props[p] for p, _, _ in block[0])

    def search(self) -> list[list[list[tuple[int, int, bool]]]]:
        """Blocks that together hold every step once: contigs shared by most variants and least copied come first; of
        overlapping candidates the heavier stays."""
        blocks = []
        while self.free:
            copies: dict[str, Counter] = defaultdict(Counter)
            for p, v in self.free:
                copies[self.paths[p][v][0]][p] += 1
            shared = max(len(c) for c in copies.values())
            first = min((max(c.values()), n) for n, c in copies.items() if len(c) == shared)[0]
            names = sorted(n for n, c in copies.items() if len(c) == shared and max(c.values()) == first)
            found = [b for n in names for b in self.candidates(n)]
            found.sort(key=lambda b: (-self.weight(b), b))
            for b in found:
                steps = {(p, v) for cell in b for p, v, _ in cell}
                if steps <= self.free:
                    blocks.append(b)
                    self.free -= steps
        return blocks


def colinear_blocks(variants: DataFrame, props: DataFrame, segments: DataFrame) -> DataFrame:
    """block_id, pos, cid, vid, e. Variants that share contigs, directly or through others, form one group (a block can't
    reach beyond it); the variants of a fit are few, and the search is held by their number and steps."""
    from .graph import checkpointed, connected_components

    steps = variants.select("cid", F.posexplode("path").alias("vid", "s")).select("cid", "vid", F.col("s.n").alias("name"), F.col("s.e").alias("e"))
    node, contig = F.concat(F.lit("v"), F.col("cid").cast("string")), F.concat(F.lit("c"), F.col("name"))
    edges = steps.select(node.alias("v1"), contig.alias("v2")).distinct()
    group = connected_components(edges.select(F.col("v1").alias("name")).distinct(), edges).select(F.substring("name", 2, 100).cast(variants.schema["cid"].dataType).alias("cid"), F.col("component").alias("g"))
    own = steps.join(segments.select("name", "len"), "name", "left").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("vid", "name", "e", F.coalesce("len", F.lit(1)).alias("len")))).alias("steps"))
    rows = variants.select("cid", "circular").join(props, "cid").join(own, "cid").join(group, "cid").select("g", "cid", "circular", "prop", F.transform("steps", lambda x: x["name"]).alias("ns"), F.transform("steps", lambda x: x["e"]).alias("es"), F.transform("steps", lambda x: x["len"]).alias("ls"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("cid")
        paths = [list(zip(list(ns), [bool(e) for e in es], strict=True)) for ns, es in zip(pdf["ns"], pdf["es"], strict=True)]
        lens = {n: int(x) for ns, ls in zip(pdf["ns"], pdf["ls"], strict=True) for n, x in zip(ns, ls, strict=True)}
        b = Blocks(paths, [bool(x) for x in pdf["circular"]], [float(x) for x in pdf["prop"]], lens)
        cids = [int(c) for c in pdf["cid"]]
        out = [(cids[0], i, pos, cids[p], v, bool(e)) for i, block in enumerate(b.search()) for pos, cell in enumerate(block) for p, v, e in cell]
        return pd.DataFrame(out, columns=["first", "i", "pos", "cid", "vid", "e"])

    found = checkpointed(rows.groupBy("g").applyInPandas(run, "first int, i int, pos int, cid int, vid int, e boolean"))
    numbers = found.select("first", "i").distinct().withColumn("block_id", F.row_number().over(Window.orderBy("first", "i")) - 1)  # a row a block
    return found.join(numbers, ["first", "i"]).select("block_id", "pos", "cid", "vid", "e")


def coverage_division(blocks: DataFrame, variants: DataFrame, props: DataFrame) -> DataFrame:
    """name, block_id, pos, share: how a contig's coverage divides over its places in blocks."""
    steps = variants.select("cid", F.posexplode("path").alias("vid", "s")).select("cid", "vid", F.col("s.n").alias("name"))
    held = blocks.select("block_id", "pos", "cid", "vid").join(steps, ["cid", "vid"]).join(props, "cid").groupBy("name", "block_id", "pos").agg(F.sum("prop").alias("p"))
    return held.select("name", "block_id", "pos", (F.col("p") / F.sum("p").over(Window.partitionBy("name"))).alias("share"))


def renamed(blocks: DataFrame, variants: DataFrame) -> DataFrame:
    """cid, vid, n, e, new: copies of a contig are named by the first use of their place in a block: v, v_copy2, …"""
    steps = variants.select("cid", F.posexplode("path").alias("vid", "s")).select("cid", "vid", F.col("s.n").alias("n"), F.col("s.e").alias("e")).join(blocks.select("cid", "vid", "block_id", "pos"), ["cid", "vid"])
    first = steps.groupBy("n", "block_id", "pos").agg(F.min(F.struct("cid", "vid")).alias("f")).withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("f")))
    named = first.select("n", "block_id", "pos", F.when(F.col("k") == 1, F.col("n")).otherwise(F.concat("n", F.lit("_copy"), F.col("k").cast("string"))).alias("new"))
    return steps.join(named, ["n", "block_id", "pos"]).select("cid", "vid", "n", "e", "new", "block_id", "pos")


def pangenome_graph(blocks: DataFrame, variants: DataFrame, props: DataFrame, segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and half-edges of the merged graph. ``variants``: cid, path, circular."""
    from .graph import symmetric

    names = renamed(blocks, variants)
    shares = coverage_division(blocks, variants, props)
    made = names.select("n", "new", "block_id", "pos").distinct().join(shares.withColumnRenamed("name", "n"), ["n", "block_id", "pos"]).groupBy("n", "new").agg(F.sum("share").alias("share"))
    segs = made.join(segments.withColumnRenamed("name", "n"), "n").select(F.col("new").alias("name"), "len", (F.col("cov") * F.col("share")).alias("cov"), "seq")
    sized = names.join(variants.select("cid", "circular", F.size("path").alias("len")), "cid")
    nxt = names.select("cid", F.col("vid").alias("next"), F.col("n").alias("n2"), F.col("e").alias("x2"), F.col("new").alias("new2"))
    pair = sized.withColumn("next", F.when(F.col("vid") + 1 < F.col("len"), F.col("vid") + 1).when(F.col("circular"), F.lit(0))).join(nxt, ["cid", "next"])
    old = pair.select(F.col("n").alias("v1"), F.col("e").alias("e1"), F.col("n2").alias("v2"), (~F.col("x2")).alias("e2"), "new", "new2").join(links.select("v1", "e1", "v2", "e2", "overlap"), ["v1", "e1", "v2", "e2"], "left")
    new = old.select(F.col("new").alias("v1"), "e1", F.col("new2").alias("v2"), "e2", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return segs, symmetric(new)


def block_table(blocks: DataFrame, variants: DataFrame, segments: DataFrame, links: DataFrame, gap: int = 0, log_scale: bool = False, by_size: bool = False) -> DataFrame:
    """block, variant (cid), start, end, real_len: a row for each stretch of a variant in one block, along the variant.
    ``start`` > ``end`` where the variant runs against the block; blocks are numbered from 1 by first use."""
    names = variants.select("cid", F.posexplode("path").alias("vid", "s")).select("cid", "vid", F.col("s.n").alias("v1"), F.col("s.e").alias("e1"))
    nxt = names.select("cid", (F.col("vid") - 1).alias("vid"), F.col("v1").alias("v2"), (~F.col("e1")).alias("e2"))
    step = names.join(nxt, ["cid", "vid"], "left").join(segments.select(F.col("name").alias("v1"), "len"), "v1").join(links.select("v1", "e1", "v2", "e2", "overlap"), ["v1", "e1", "v2", "e2"], "left").withColumn("adds", F.col("len") - F.coalesce("overlap", F.lit(0)))
    placed = step.join(blocks.select("block_id", "pos", "cid", "vid", F.col("e").alias("be")), ["cid", "vid"])
    along = Window.partitionBy("cid").orderBy("vid")
    turn = F.when((F.lag("block_id").over(along) == F.col("block_id")) & (F.abs(F.lag("pos").over(along) - F.col("pos")) == 1), 0).otherwise(1)
    runs = placed.withColumn("turn", turn).withColumn("run", F.sum("turn").over(along))
    # ``be`` says whether the block reads the step's contig forward; the variant agrees if it does too.
    table = runs.groupBy("cid", "run").agg(F.first("block_id").alias("block_id"), F.sum("adds").alias("real_len"), F.min("vid").alias("vid"), F.min_by(F.col("be") == F.col("e1"), "vid").alias("same"))
    order = Window.partitionBy("cid").orderBy("run")
    ahead = F.coalesce(F.sum("real_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.log("real_len") if log_scale else F.col("real_len")
    if log_scale:
        ahead = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    put = table.withColumn("ahead", ahead).withColumn("size", size).withColumn("shift", (F.row_number().over(order) - 1) * gap)
    a, z = F.col("ahead") + F.col("shift") + 1, F.col("ahead") + F.col("shift") + F.col("size")
    first = table.groupBy("block_id").agg(F.min(F.struct("cid", "run")).alias("f"), F.max("real_len").alias("most"))
    ranked = first.select("block_id", F.row_number().over(Window.orderBy(*([F.desc("most")] if by_size else []), "f")).alias("block"))
    return put.join(ranked, "block_id").select("block", F.col("cid").alias("variant"), F.when(F.col("same"), a).otherwise(z).alias("start"), F.when(F.col("same"), z).otherwise(a).alias("end"), "real_len")
