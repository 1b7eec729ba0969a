"""Small formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_count(read_len: Column, steps: Column, full_len: Column, inner_len: Column, left_free: Column, right_free: Column) -> Column:
    """In how many places a read of this length can start so that it aligns to exactly this sub-path.

    ``left_free`` and ``right_free`` are the outer contigs' lengths less their overlap with the next contig.
    """
    most = read_len - (inner_len + 2) + 1
    many = most - F.greatest(most - left_free, F.lit(0)) - F.greatest(most - right_free, F.lit(0))
    return F.when(steps == 1, full_len - read_len + 1).otherwise(many)


def aic(loglik: Column, k: Column) -> Column:
    return 2 * k - 2 * loglik


def bic(loglik: Column, k: Column, n: Column) -> Column:
    return F.log(n) * k - 2 * loglik


def harmony_weights(w: Column, differ: float, *by: str) -> Column:
    """w ** differ as a share of its group's sum."""
    return F.pow(w, F.lit(differ)) / F.sum(F.pow(w, F.lit(differ))).over(Window.partitionBy(*by))


def gcd_of(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers, by Euclid's steps in a fold."""

    def gcd(a: Column, b: Column) -> Column:
        pair = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        turns = F.sequence(F.lit(1), F.lit(92))  # enough for any two 64-bit numbers
        return F.aggregate(turns, pair, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))), lambda s: s["x"])

    return F.aggregate(F.transform(values, lambda v: F.abs(v).cast("long")), F.lit(0).cast("long"), gcd)


def index_in_breaks(breaks: Column, seek: Column) -> Column:
    """Last index (from 0) of an increasing array whose value is at most ``seek``, and the gap to it: struct<i, gap>."""
    at = F.size(F.filter(breaks, lambda b: b <= seek)) - 1
    return F.struct(at.alias("i"), (seek - F.get(breaks, at)).alias("gap"))


def floor_in(seeks: DataFrame, seek: str, breaks: DataFrame, at: str, width: int = 1024) -> DataFrame:
    """``seeks`` with ``idx`` (how many distinct breaks lie at or below ``seek``, less one) and ``gap`` to the last of them;
    -1 and null where there is none. Whole numbers are looked up in buckets of ``width``, so a row meets at most ``width``
    breaks; a bucket takes over the count and the last break of those before it."""
    bucket = lambda c: F.floor(F.col(c) / width).alias("bucket")
    held = breaks.select(F.col(at).alias("b")).distinct().groupBy(bucket("b")).agg(F.array_sort(F.collect_list("b")).alias("own"))
    rows = seeks.withColumn("bucket", bucket(seek))
    every = held.select("bucket").union(rows.select("bucket")).distinct().join(held, "bucket", "left")
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = every.select("bucket", "own", F.coalesce(F.sum(F.coalesce(F.size("own"), F.lit(0))).over(ahead), F.lit(0)).alias("before"), F.last(F.element_at("own", -1), ignorenulls=True).over(ahead).alias("last"))
    low = F.filter(F.coalesce("own", F.array().cast(held.schema["own"].dataType)), lambda b: b <= F.col(seek))
    got = rows.join(carried, "bucket").withColumn("low", low)
    floor = F.when(F.size("low") > 0, F.element_at("low", -1)).otherwise(F.col("last"))
    return got.select(*seeks.columns, (F.col("before") + F.size("low") - 1).alias("idx"), (F.col(seek) - floor).alias("gap"))
