"""Read paths: counting, support from longer paths, coverage, and the indexes that the search uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def count_paths(reads: DataFrame, path: str = "path") -> DataFrame:
    """path (canonical), n: how many reads have it on either strand."""
    return reads.filter(F.size(path) > 0).groupBy(P.canonical(F.col(path)).alias("path")).agg(F.count("*").alias("n"))


def with_records(reads: DataFrame, path: str = "path", record: str = "record_id") -> DataFrame:
    """path, record_ids (rising), n."""
    return reads.filter(F.size(path) > 0).groupBy(P.canonical(F.col(path)).alias("path")).agg(F.array_sort(F.collect_list(record)).alias("record_ids"), F.count("*").alias("n"))


def supported(counts: DataFrame, least: int) -> DataFrame:
    """path, n, support: paths whose own reads plus their occurrences in distinct longer paths reach ``least``.

    Longer paths lend support whether they are kept or not. The theta-join of shorter with longer paths is an equi-join
    on canonical windows; the windows are counted before they are joined.
    """
    inner = counts.select(F.explode(P.windows(F.col("path"), F.size("path") - 1)).alias("w")).groupBy(P.canonical(F.col("w")).alias("path")).agg(F.count("*").alias("held"))
    total = F.col("n") + F.coalesce("held", F.lit(0))
    return counts.join(inner, "path", "left").select("path", "n", total.alias("support")).filter(F.col("support") >= least)


def coverage(counts: DataFrame) -> DataFrame:
    """name, cov: reads over each contig, counting every occurrence."""
    return counts.select(F.explode("path").alias("s"), "n").groupBy(F.col("s.n").alias("name")).agg((F.sum("n") + F.lit(1e-8)).alias("cov"))


def start_index(counts: DataFrame) -> DataFrame:
    """sub, path, n: a row for each proper beginning of a read path (either strand) and path that continues it."""
    both = counts.select(F.explode(F.array_distinct(F.array("path", P.reverse_path(F.col("path"))))).alias("p"), "n")
    heads = both.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda k: F.slice("p", F.lit(1), k))).alias("sub"), "p", "n").filter(F.size("sub") < F.size("p"))
    return heads.select("sub", F.col("p").alias("path"), "n").distinct()


def middle_index(counts: DataFrame) -> DataFrame:
    """sub, path, n: a row for each interior run of a read path (either strand) and path that holds it."""
    both = counts.select(F.explode(F.array_distinct(F.array("path", P.reverse_path(F.col("path"))))).alias("p"), "n").filter(F.size("p") > 2)
    runs = both.select(F.explode(F.array_distinct(P.windows(F.slice("p", F.lit(2), F.size("p") - 2), F.size("p") - 2))).alias("sub"), "p", "n")
    return runs.select("sub", F.col("p").alias("path"), "n").distinct()


def longest(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max(F.size("path")).alias("steps"))


def uncovered(counts: DataFrame, sub_paths: DataFrame) -> DataFrame:
    """Read paths that no variant holds; ``sub_paths`` has their canonical paths."""
    return counts.join(sub_paths.select("path").distinct(), "path", "left_anti")


def coverage_ratio(counts: DataFrame, sub_paths: DataFrame) -> DataFrame:
    """uncovered_ratio: the share of reads on paths that no variant holds. One row."""
    held = sub_paths.select("path").distinct().withColumn("held", F.lit(1))
    return counts.join(held, "path", "left").agg((F.sum(F.when(F.col("held").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("uncovered_ratio"))
