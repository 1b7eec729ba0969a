"""Error-free reads from variants of known proportions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Mean and deviation of read lengths by technology.
LENGTHS = {"ont": (15000, 13000), "pb": (13000, 10000), "hifi": (15000, 10000)}
SHORTEST = 100


def read_lengths(spark: SparkSession, mean: float, std: float, bases: int, seed: int = 12345, blocks: int = 8) -> DataFrame:
    """idx, len: gamma lengths of at least SHORTEST bases until they add up to ``bases``. Each block of draws is seeded by
    its number; the cut is made on sums of blocks first, so no task sees all reads."""
    shape, scale = (mean / std) ** 2, std**2 / mean
    each = max(16, int(bases / mean * 1.6 / blocks) + 16)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for block in b.column(0).to_pylist():
                x = np.random.default_rng([seed, block]).gamma(shape, scale, each).astype(np.int64)
                i = np.flatnonzero(x >= SHORTEST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(block * each + i), pa.array(x[i])], names=["block", "idx", "len"])

    drawn = spark.range(0, blocks, 1, blocks).mapInArrow(run, "block long, idx long, len long")
    before = drawn.groupBy("block").agg(F.sum("len").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("len").over(Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return drawn.withColumn("own", own).join(F.broadcast(before.select("block", "ahead")), "block").filter(F.col("ahead") + F.col("own") < bases).select("idx", "len")


def uniform(*key) -> object:
    """A number in [0, 1) that follows from the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / float(1 << 53)


def offsets(variants: DataFrame) -> DataFrame:
    """cid, circular, size, starts, lens, path: where each step of a measured variant begins. """
    ahead = F.transform(F.sequence(F.lit(0), F.size("lens") - 1), lambda i: F.aggregate(F.slice("lens", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) - F.aggregate(F.slice("ovs", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    from .variants import full_length

    return variants.select("cid", "circular", "path", "lens", (full_length() - F.when(F.col("circular"), F.element_at("ovs", -1)).otherwise(0)).alias("size"), ahead.alias("starts"))


def simulate(spark: SparkSession, variants: DataFrame, props: DataFrame, lengths: DataFrame, seed: int = 12345) -> DataFrame:
    """Alignment records of perfect reads. ``variants`` is measured and has circular; props: cid, prop (sum 1).

    A read takes a variant by an as-of lookup of its draw in the cumulative shares (weighted by size), a uniform start,
    and the steps that its span touches. Reads longer than a linear variant are cut to it.
    """
    off = offsets(variants).join(props, "cid")
    shares = off.withColumn("w", F.col("prop") * F.col("size"))
    total = shares.agg(F.sum("w").alias("t"))
    cum = shares.crossJoin(F.broadcast(total)).withColumn("hi", F.sum(F.col("w") / F.col("t")).over(Window.orderBy("cid"))).withColumn("lo", F.col("hi") - F.col("w") / F.col("t")).drop("w", "t")
    draws = lengths.withColumn("u", uniform("idx", F.lit(seed)))
    got = draws.join(F.broadcast(cum), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))  # a row for each variant
    span = F.when(F.col("circular"), F.col("len")).otherwise(F.least("len", "size"))
    room = F.when(F.col("circular"), F.col("size")).otherwise(F.col("size") - span + 1)
    got = got.withColumn("span", span).withColumn("start", F.floor(uniform("idx", F.lit(seed + 1)) * room).cast("long"))
    n = F.size("path")
    turns = F.when(F.col("circular"), F.ceil((F.col("start") + F.col("span")) / F.col("size")).cast("int")).otherwise(1)
    steps = F.flatten(F.transform(F.sequence(F.lit(0), turns - 1), lambda t: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.get("starts", i) + t * F.col("size")).alias("a"), (F.get("starts", i) + t * F.col("size") + F.get("lens", i)).alias("z"), F.get("path", i).alias("s")))))
    hit = F.filter(steps, lambda x: (x["a"] < F.col("start") + F.col("span")) & (x["z"] > F.col("start")))
    # A contig that the read only enters or leaves within an overlap is covered by its neighbour: the least walk is kept.
    got = got.withColumn("hit", hit)
    first = F.size(F.filter("hit", lambda x: x["a"] <= F.col("start"))) - 1
    last = F.array_position(F.transform("hit", lambda x: x["z"] >= F.col("start") + F.col("span")), F.lit(True))
    a = F.greatest(F.least(first, last - 1), F.lit(0))
    walk = F.slice("hit", (a + 1).cast("int"), F.greatest((last - a).cast("int"), F.lit(1)))
    got = got.withColumn("walk", walk).withColumn("p_start", F.col("start") - F.get("walk", F.lit(0))["a"])
    whole = F.element_at("walk", -1)["z"] - F.get("walk", F.lit(0))["a"]
    return got.select(
        F.col("idx").alias("record_id"), F.concat(F.lit("sim"), F.col("idx").cast("string")).alias("query_name"), F.col("span").cast("int").alias("query_len"), F.lit(0).alias("q_start"), F.col("span").cast("int").alias("q_end"), F.lit(True).alias("q_strand"),
        F.transform("walk", lambda x: x["s"]).alias("path"), whole.cast("int").alias("p_len"), F.col("p_start").cast("int").alias("p_start"), (F.col("p_start") + F.col("span")).cast("int").alias("p_end"), F.col("span").cast("int").alias("p_align_len"),
        F.col("span").cast("int").alias("num_match"), F.col("span").cast("int").alias("align_len"), F.lit(60).alias("mapq"), F.lit(1.0).alias("identity"), "cid",
    )
