"""Deterministic adapters from the TPC-H-like tables to reads, segments, links and variants.

A read is an order, its steps are the order's lines; a variant is a nation's suppliers in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

#: Order of the lines of an order; it is total up to fully equal lines.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity", "l_extendedprice")
CONTIGS = 8
OVERLAP = 55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, k (from 1), n, e, s (supplier contig), len, ident, gap, row (place in the table's files)."""
    li = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return li.select(
        F.col("l_orderkey").alias("read"),
        k.alias("k"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % CONTIGS).cast("string")).alias("n"),
        (F.col("l_linestatus") == "F").alias("e"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"),
        (F.col("l_quantity") * 100).cast("int").alias("len"),
        (1 - (F.col("l_discount") + 0.0) / 10).alias("ident"),
        F.round(F.col("l_tax") * 1000 - 40).cast("int").alias("gap"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("row"),
    )


def reads(spark: SparkSession, sf_dir: str, name: str = "n") -> DataFrame:
    """read, path, len: one row per order. The sort is within the group; an order has few lines."""
    li = table(spark, sf_dir, "lineitem")
    n = F.concat(F.lit("c"), (F.col("l_suppkey") % CONTIGS).cast("string")) if name == "n" else F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    e = F.col("l_linestatus") == "F"
    rows = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, n.alias("n"), e.alias("e"))))
    return li.groupBy(F.col("l_orderkey").alias("read")).agg(rows.alias("r"), F.sum((F.col("l_quantity") * 100).cast("int")).alias("len")).select(
        "read", F.transform("r", lambda x: F.struct(x["n"].alias("n"), x["e"].alias("e"))).alias("path"), "len"
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight segments c0 to c7: lengths in steps, coverage from the lines, an invented sequence."""
    li = table(spark, sf_dir, "lineitem")
    return _segments(li.groupBy((F.col("l_suppkey") % CONTIGS).alias("g")).agg(F.max(F.col("l_suppkey") % CONTIGS).alias("i"), F.avg("l_quantity").alias("cov")), "c", F.lit(1000) + 250 * F.col("i"))


def supplier_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return _segments(li.groupBy(F.col("l_suppkey").alias("g")).agg(F.max("l_suppkey").alias("i"), F.avg("l_quantity").alias("cov")), "s", F.lit(1000) + 250 * (F.col("i") % 9))


def _segments(rows: DataFrame, letter: str, length) -> DataFrame:
    """``i`` is an aggregate and not the grouping key, so filters on a sequence stay above the aggregation."""
    name = F.concat(F.lit(letter), F.col("i").cast("string"))
    return rows.select(name.alias("name"), length.cast("int").alias("len"), "cov").withColumn("seq", F.substring(F.translate(F.repeat(F.md5(F.col("name").cast("binary")), 110), "0123456789abcdef", "ACGTTGCAACGTCATG"), F.lit(1), F.col("len")))


def links_of(paths: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Half-edges of paths (column ``path``): both directions of every neighbour pair whose support is at least
    ``min_share`` times the mean support."""
    one = paths.select(F.explode(P.links(F.col("path"))).alias("l")).select("l.*")
    both = one.union(one.select(F.col("v2").alias("v1"), F.col("e2").alias("e1"), F.col("v1").alias("v2"), F.col("e1").alias("e2")))
    counted = both.groupBy("v1", "e1", "v2", "e2").agg(F.count("*").alias("support"))
    mean = counted.agg((F.sum("support") / F.count("*")).alias("mean"))  # one row
    return counted.crossJoin(F.broadcast(mean)).filter(F.col("support") >= min_share * F.col("mean")).select("v1", "e1", "v2", "e2", F.lit(OVERLAP).alias("overlap"), "support")


def contig_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(reads(spark, sf_dir))


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(reads(spark, sf_dir, "s"), 2.5)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cid, path: a nation's suppliers in key order."""
    su = table(spark, sf_dir, "supplier")
    row = F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("c"), (F.col("s_suppkey") % CONTIGS).cast("string")).alias("n"), (F.col("s_acctbal") > 0).alias("e"))))
    return su.groupBy(F.col("s_nationkey").alias("cid")).agg(row.alias("r")).select("cid", F.transform("r", lambda x: F.struct(x["n"].alias("n"), x["e"].alias("e"))).alias("path"))
