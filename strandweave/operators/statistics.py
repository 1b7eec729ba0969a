"""Weighted moments and base transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bases of a piece of a sequence.
PIECE = 1 << 16


def weighted(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """``by``, mean, std: weighted, in two passes so that large means cost no digits."""
    mean = rows.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
    got = rows.join(mean, by)
    return got.groupBy(by).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col(weight) * F.pow(F.col(value) - F.col("mean"), 2)) / F.sum(weight)).alias("std"))


def transitions(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, base, n, share: which base follows each run of k bases; a degenerate base counts in equal parts for each base
    that it stands for."""
    from ..functions.sequences import bases_of

    # Sequences go in pieces that overlap by k; one pass over a piece lists all its runs of k + 1 bases.
    begins = F.explode(F.sequence(F.lit(1), F.length("seq") - k, F.lit(PIECE)))
    pieces = seqs.filter(F.length("seq") > k).select("seq", begins.alias("i")).select(F.substring(F.col("seq"), F.col("i"), F.lit(PIECE + k)).alias("piece"))
    at = pieces.select(F.explode(F.regexp_extract_all("piece", F.lit(f"(?s)(?=(.{{{k + 1}}}))"), F.lit(1))).alias("x"))
    pair = at.select(F.substring("x", 1, k).alias("kmer"), bases_of(F.substring("x", k + 1, 1)).alias("b"))
    each = pair.groupBy("kmer", "b").agg(F.count("*").alias("c")).select("kmer", (F.col("c") / F.length("b")).alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.length("b")), lambda i: F.substring(F.col("b"), i, F.lit(1)))).alias("base"))
    got = each.groupBy("kmer", "base").agg(F.sum("w").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kmer")))
