"""Bootstrap and jackknife with draws that depend on logical ids only, so any partitioning gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def draw(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that follows from the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % n


def numbered(records: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, gapless from 0 in the order of the columns, without gathering the rows in one task: they are range
    partitioned and sorted, and each partition starts where the ones before it end."""
    placed = checkpointed(records.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("m", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("start"))  # a row a partition
    return placed.join(F.broadcast(starts), "part").withColumn("idx", F.col("start") + F.col("at")).drop("m", "part", "at", "start")


def bootstrap(records: DataFrame, replicates: int, seed: int = 12345, first: int = 1) -> DataFrame:
    """rep, idx, n: how often each record (``idx`` from 0, gapless) is drawn in each replicate; every replicate draws as
    many as there are. One job for all replicates."""
    total = records.agg(F.count("*").alias("total"))
    slots = records.select("idx").crossJoin(F.broadcast(total)).select("total", "idx", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))).alias("rep"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("idx").cast("string"))
    return slots.select("rep", draw(key, F.col("total")).alias("idx")).groupBy("rep", "idx").agg(F.count("*").alias("n"))


def jackknife(records: DataFrame, replicates: int, leave: int, seed: int = 12345) -> DataFrame:
    """rep, idx: each replicate leaves out the ``leave`` records of lowest hash."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("idx").cast("string")).cast("binary"))
    slots = records.select("idx", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    slots = slots.withColumn("key", key).withColumn("head", F.substring("key", 1, 4))
    # Of 65,536 classes of hashes those that hold the ``leave`` lowest; rows are ranked within a class only.
    sizes = slots.groupBy("rep", "head").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rep").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = sizes.select("rep", "head", before.alias("before")).filter(F.col("before") < leave)
    place = F.col("before") + F.row_number().over(Window.partitionBy("rep", "head").orderBy("key", "idx"))
    out = slots.join(low, ["rep", "head"]).withColumn("place", place).filter(F.col("place") <= leave).select("rep", "idx")
    return slots.select("rep", "idx").join(out, ["rep", "idx"], "left_anti")


def support(chosen: DataFrame) -> DataFrame:
    """solution (cids joined by commas), support: the share of replicates that chose exactly these variants."""
    solved = chosen.groupBy("rep").agg(F.array_join(F.array_sort(F.collect_list("cid")), ",").alias("solution"))
    return solved.groupBy("solution").agg(F.count("*").alias("n")).withColumn("support", F.col("n") / F.sum("n").over(Window.partitionBy())).select("solution", "support")


def ordered(solutions: DataFrame, raw: str) -> DataFrame:
    """Solutions by falling support, the raw result first among equals."""
    return solutions.orderBy(F.desc("support"), (F.col("solution") != raw).cast("int"), "solution")


def spread(props: DataFrame) -> DataFrame:
    """cid, mean, std over replicates (sample deviation)."""
    return props.groupBy("cid").agg(F.avg("prop").alias("mean"), F.stddev_samp("prop").alias("std"))


def can_still_reach(best: int, done: int, planned: int, threshold: float) -> bool:
    """Whether the best solution so far can still reach the support threshold."""
    return (best + planned - done) / planned >= threshold


def last_useful(solutions: list[tuple], planned: int, threshold: float) -> tuple[int, bool]:
    """How many of the replicates' solutions count, and whether some solution can still reach the wanted support: the
    first replicate after which none can is the last."""
    counts: dict[tuple, int] = {}
    for done, s in enumerate(solutions, 1):
        counts[s] = counts.get(s, 0) + 1
        if not can_still_reach(max(counts.values()), done, planned, threshold):
            return done, False
    return len(solutions), True


def first_seen(chosen: DataFrame) -> DataFrame:
    """cid, fid: variants numbered from 1 in the order of their first solution (``place``) and cid."""
    first = chosen.groupBy("cid").agg(F.min("place").alias("place"))
    return first.select("cid", F.row_number().over(Window.orderBy("place", "cid")).alias("fid"))
