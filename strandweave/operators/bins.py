"""Length bins of the multinomial model and their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .variants import full_length, inner_length


def describe(sub_paths: DataFrame) -> DataFrame:
    """path, steps, full_len, inner_len, left_free, right_free, lo, hi of measured sub-paths (key ``path``)."""
    n = F.size("path")
    full, inner = full_length(), inner_length()
    return sub_paths.select(
        "path",
        n.alias("steps"),
        full.alias("full_len"),
        inner.alias("inner_len"),
        F.when(n > 1, F.get("lens", F.lit(0)) - F.get("ovs", F.lit(0))).alias("left_free"),
        F.when(n > 1, F.get("lens", n - 1) - F.get("ovs", n - 2)).alias("right_free"),
        F.when(n > 1, inner + 2).otherwise(1).cast("long").alias("lo"),
        full.alias("hi"),
    ).filter("lo <= hi")


def placed_lengths(described: DataFrame, lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """len, bin_id, lo, hi of every distinct length that lies in a bin. The length axis is cut at every start and behind every
    end of a sub-path's range. With ``by`` (replicates, say) each of these has an axis and bins of its own.

    Lengths take the last cut at or before them from one ordered pass, not from a range join. Both are numbers of bases up
    to the longest read or sub-path, so that pass is bounded by it, however many reads there are.
    """
    cuts = described.select(*by, F.col("lo").alias("b")).union(described.select(*by, F.col("hi") + 1)).distinct()
    ranges = cuts.select(*by, F.col("b").alias("lo"), (F.lead("b").over(Window.partitionBy(*by).orderBy("b")) - 1).alias("hi")).filter("hi is not null")
    marks = cuts.select(*by, F.col("b").alias("at"), F.lit(0).alias("kind"), F.col("b").alias("cut")).union(
        lengths.select(*by, F.col("len").cast("long").alias("at")).distinct().select(*by, "at", F.lit(1), F.lit(None).cast("long"))
    )
    last = F.last("cut", ignorenulls=True).over(Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = marks.withColumn("lo", last).filter("kind = 1 and lo is not null").select(*by, F.col("at").alias("len"), "lo").join(ranges, [*by, "lo"])
    return held.select(*by, "len", F.dense_rank().over(Window.partitionBy(*by).orderBy("lo")).alias("bin_id"), "lo", "hi")


def length_bins(described: DataFrame, lengths: DataFrame) -> DataFrame:
    """bin_id, lo, hi: bins with at least one observed length."""
    return placed_lengths(described, lengths).select("bin_id", "lo", "hi").distinct()


def cells(placed: DataFrame, described: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """bin_id, path, num_matched, num_possible_x. ``placed``: see ``placed_lengths``; ``reads`` has path (canonical), len and
    n (how many such reads there are).

    Reads are counted by length first. The number of starts grows linearly with the length but for two bends a
    sub-path, so its sum over a bin follows from running sums of reads and of bases at the bends and the bin's end; no
    cell meets the lengths of its bin.
    """
    by_len = reads.groupBy(*by, F.col("len").cast("long").alias("len")).agg(F.sum("n").alias("c"))
    span = by_len.groupBy(*by).agg((F.min("len") - 1).alias("least"), F.max("len").alias("most"))
    axis = span.filter("most is not null").select(*by, F.explode(F.sequence("least", "most")).alias("len"))  # a row for each base of the longest read
    up_to = Window.partitionBy(*by).orderBy("len")
    c = F.coalesce("c", F.lit(0))
    sums = axis.join(by_len, [*by, "len"], "left").select(*by, F.col("len").alias("at"), F.sum(c).over(up_to).alias("reads"), F.sum(c * F.col("len")).over(up_to).alias("bases"))
    spanned = placed.join(by_len, [*by, "len"]).groupBy(*by, "bin_id").agg(F.first("lo").alias("b_lo"), F.first("hi").alias("b_hi"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("len")).alias("l"))
    own = reads.groupBy(*by, "path", F.col("len").cast("long").alias("len")).agg(F.sum("n").alias("m"))
    matched = own.join(described.select(*by, "path"), [*by, "path"], "left_semi").join(placed.select(*by, "len", "bin_id"), [*by, "len"]).groupBy(*by, "bin_id", "path").agg(F.sum("m").alias("num_matched"))
    facts = matched.join(described.drop("lo", "hi"), [*by, "path"]).join(spanned, [*by, "bin_id"])
    facts = facts.join(span, list(by)) if by else facts.crossJoin(F.broadcast(span))
    inside = lambda x: F.least(F.greatest(F.coalesce(x, F.col("b_lo")), F.col("b_lo") - 1, F.col("least")), F.col("b_hi"), F.col("most"))
    left, right = F.col("inner_len") + 1 + F.col("left_free"), F.col("inner_len") + 1 + F.col("right_free")
    facts = facts.withColumn("end", F.least("b_hi", "most")).withColumn("bend1", inside(left)).withColumn("bend2", inside(right))
    for x in ("end", "bend1", "bend2"):
        facts = facts.join(sums.select(*by, F.col("at").alias(x), F.col("reads").alias(f"reads_{x}"), F.col("bases").alias(f"bases_{x}")), [*by, x])
    beyond = lambda bend, x: F.col("bases_end") - F.col(f"bases_{bend}") - x * (F.col("reads_end") - F.col(f"reads_{bend}"))
    one = (F.col("full_len") + 1) * F.col("c") - F.col("l")
    many = F.col("l") - (F.col("inner_len") + 1) * F.col("c") - beyond("bend1", left) - beyond("bend2", right)
    return facts.select(*by, "bin_id", "path", "num_matched", (F.when(F.col("steps") == 1, one).otherwise(many) / F.col("c")).alias("num_possible_x"))


def usable(cell_rows: DataFrame) -> DataFrame:
    """Cells in which a read can start at all."""
    return cell_rows.filter("num_possible_x >= 1")
