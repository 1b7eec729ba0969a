"""Candidate variants: lengths along the graph, sub-path counts, unidentifiable groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

STEP_T = "struct<n:string,e:boolean>"


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def measured(paths: DataFrame, segments: DataFrame, links: DataFrame, key: str = "cid") -> DataFrame:
    """Adds ``lens`` (of every step) and ``ovs`` (with the next step; the last with the first, 0 where there is no link).

    Paths are exploded once, joined with both graph tables on their keys, and put together again.
    """
    n = F.size("path")
    steps = paths.select(key, F.posexplode("path").alias("i", "s"), "path", n.alias("n")).select(
        key, "i", F.col("s.n").alias("v1"), F.col("s.e").alias("e1"), F.get("path", (F.col("i") + 1) % F.col("n"))["n"].alias("v2"), (~F.get("path", (F.col("i") + 1) % F.col("n"))["e"]).alias("e2")
    )
    got = steps.join(segments.select(F.col("name").alias("v1"), "len"), "v1").join(links.select("v1", "e1", "v2", "e2", "overlap"), ["v1", "e1", "v2", "e2"], "left")
    rows = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("len").cast("long").alias("len"), F.coalesce("overlap", F.lit(0)).cast("long").alias("ov")))).alias("r"))
    return paths.join(rows, key).withColumn("lens", F.transform("r", lambda x: x["len"])).withColumn("ovs", F.transform("r", lambda x: x["ov"])).drop("r")


def full_length() -> Column:
    """Length of a measured path, its ends' overlaps counted once."""
    return total(F.col("lens")) - total(F.slice("ovs", F.lit(1), F.size("ovs") - 1))


def inner_length() -> Column:
    """Bases between the outer contigs; overlaps with these stay."""
    n = F.size("lens")
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(
        F.greatest(total(F.slice("lens", F.lit(2), n - 2)) - F.when(n > 3, total(F.slice("ovs", F.lit(2), F.greatest(n - 3, F.lit(0))))).otherwise(0), F.lit(0).cast("long"))
    )


def sizes(variants: DataFrame) -> DataFrame:
    """cid, path, circular, size: a circular variant's closing overlap is counted once. Input: measured, with circular."""
    return variants.select("cid", "path", "circular", (full_length() - F.when(F.col("circular"), F.element_at("ovs", -1)).otherwise(0)).alias("size"))


def path_sequence(paths: DataFrame, segments: DataFrame, links: DataFrame, key: str = "cid") -> DataFrame:
    """key, seq: contig sequences along the path, each without its overlap with the next; circular paths end before
    they repeat their start. ``paths`` has key, path and circular."""
    from ..functions.sequences import reverse_complement

    n = F.size("path")
    steps = paths.select(key, F.posexplode("path").alias("i", "s"), "path", n.alias("n"), "circular").select(
        key, "i", "n", "circular", F.col("s.n").alias("v1"), F.col("s.e").alias("e1"), F.get("path", (F.col("i") + 1) % F.col("n"))["n"].alias("v2"), (~F.get("path", (F.col("i") + 1) % F.col("n"))["e"]).alias("e2")
    )
    got = steps.join(segments.select(F.col("name").alias("v1"), "len", "seq"), "v1").join(links.select("v1", "e1", "v2", "e2", "overlap"), ["v1", "e1", "v2", "e2"], "left")
    ends = (F.col("i") == F.col("n") - 1) & ~F.col("circular")
    piece = F.substring(F.when(F.col("e1"), F.col("seq")).otherwise(reverse_complement(F.col("seq"))), F.lit(1), F.col("len") - F.when(ends, 0).otherwise(F.coalesce("overlap", F.lit(0))))
    return got.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def size_filter(variants: DataFrame, ratio: float) -> DataFrame:
    """Variants of at least ``ratio`` of the largest size; fixed ones always stay. Input has size and source."""
    most = variants.agg(F.max("size").alias("most"))
    return variants.crossJoin(F.broadcast(most)).filter((F.col("size") >= F.col("most") * ratio) | (F.col("source") == "user_fixed")).drop("most")


def merge_candidates(user: DataFrame, searched: DataFrame) -> DataFrame:
    """User variants first, then searched ones in the order they were found; each path once. Input: path, source, ord."""
    rank = F.when(F.col("source") == "user_fixed", 0).when(F.col("source") == "user", 1).otherwise(2)
    both = user.unionByName(searched).withColumn("rank", rank)
    first = both.groupBy("path").agg(F.min(F.struct("rank", "ord", "source")).alias("m")).select("path", "m.*")
    return first.select((F.row_number().over(Window.orderBy("rank", "ord", "path")) - 1).alias("cid"), "path", "source")


def sub_paths(variants: DataFrame, longest_alignment: int, counts: DataFrame | None = None) -> DataFrame:
    """cid, path (canonical), freq: runs of a variant that an alignment of at most ``longest_alignment`` bases can span.

    Runs of circular variants wrap around, as often as the length allows. With ``counts`` only observed read paths stay.
    Input: measured variants with circular.
    """
    n = F.size("path")
    ring = F.greatest(total(F.col("lens")) - total(F.col("ovs")), F.lit(1))
    turns = F.when(F.col("circular"), F.ceil(F.lit(float(longest_alignment)) / ring).cast("int") + 2).otherwise(F.lit(1))
    rep = lambda c: F.flatten(F.array_repeat(F.col(c), turns))
    # What each step adds to a run: its length less its overlap with the step before.
    ext = variants.select("cid", "circular", n.alias("n"), rep("path").alias("p"), rep("lens").alias("ls"), rep("ovs").alias("os"))
    ext = ext.withColumn("adds", F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("ls", i) - F.when(i == 0, 0).otherwise(F.get("os", i - 1))))
    # Running sums of what the steps add, so that a run's inner length is a difference.
    steps = ext.select("cid", "n", F.posexplode(F.arrays_zip("p", "adds")).alias("j", "x"))
    sums = F.sum("x.adds").over(Window.partitionBy("cid").orderBy("j"))
    rows = steps.select("cid", "n", "j", F.col("x.p").alias("s"), sums.alias("sum")).groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("j", "s", "sum"))).alias("r"))
    ends = rows.select("cid", "n", F.transform("r", lambda x: x["s"]).alias("p"), F.transform("r", lambda x: x["sum"]).alias("sums"))
    starts = ends.select("cid", "p", "sums", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    inner = lambda k: F.get("sums", F.col("i") + k - 2) - F.get("sums", F.col("i"))
    fits = F.filter(F.sequence(F.lit(1), F.size("p") - F.col("i")), lambda k: (k <= 2) | (inner(k) <= longest_alignment - 2))
    runs = starts.select("cid", F.explode(F.transform(fits, lambda k: F.slice("p", F.col("i") + 1, k))).alias("run"))
    out = runs.groupBy("cid", P.canonical(F.col("run")).alias("path")).agg(F.count("*").cast("int").alias("freq"))
    return out.join(counts.select("path"), "path", "left_semi") if counts is not None else out


def unidentifiable(sub: DataFrame, sized: DataFrame) -> DataFrame:
    """cid, representative: variants of one size with the same sub-path counts share the least cid."""
    print_of = sub.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("path", "freq"))).alias("f"))
    key = Window.partitionBy("f", "size")
    return sized.select("cid", "size").join(print_of, "cid", "left").select("cid", F.min("cid").over(key).alias("representative"))


def from_variants(sub: DataFrame) -> DataFrame:
    """path, variants: for each sub-path the variants that hold it, with counts."""
    return sub.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cid", "freq")))).alias("variants"))


def indispensable(sub: DataFrame) -> DataFrame:
    """Variants that alone hold some sub-path."""
    return sub.groupBy("path").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).filter("n = 1").select("cid").distinct()
