"""Alignment records: grouping into reads, identity filters, block finding, automatic thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ends of a block that are shorter than this are cut off.
MIN_WING = 10


def by_read(records: DataFrame, order: str = "record_id") -> DataFrame:
    """query_name, p_align_len and length-weighted p_identity. A null identity passes as 1.

    The weighted identities of a read are added one by one in the order of column ``order``, so the last bit of a mean, and
    with it a read just at a threshold, doesn't depend on how rows are spread.
    """
    ident = F.coalesce("identity", F.lit(1.0))
    # One array for each read; a read has few records.
    part = F.struct(F.col(order).alias("o"), (F.col("p_align_len") * ident).cast("double").alias("x"))
    got = records.groupBy("query_name").agg(F.sum("p_align_len").alias("p_align_len"), F.sort_array(F.collect_list(part)).alias("xs"), F.count("*").alias("n_records"))
    known = F.filter("xs", lambda r: r["x"].isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, r: s + r["x"]))
    return got.select("query_name", "p_align_len", (total / F.col("p_align_len")).alias("p_identity"), "n_records")


def sort_records(records: DataFrame) -> DataFrame:
    """Adds ``go_r``, a record's place in its read by query start and end."""
    return records.withColumn("go_r", F.row_number().over(Window.partitionBy("query_name").orderBy("q_start", "q_end", "record_id")) - 1)


def with_gaps(records: DataFrame) -> DataFrame:
    """Adds ``gap``, the query bases to the next record of the read (negative: they overlap), null for the last."""
    order = Window.partitionBy("query_name").orderBy("q_start", "q_end", "record_id")
    return records.withColumn("gap", F.lead("q_start").over(order) - F.col("q_end"))


def find_blocks(records: DataFrame, min_length: int, min_identity: float, strict: bool = False) -> DataFrame:
    """query_name, block (from 1), len, ident, records (places in the read): continuous stretches of good records.

    Records of a read are taken from left to right; gaps stand in as elements of identity 0, and an overlap shortens the
    earlier record. An element joins the open block while the block's weighted identity stays at ``min_identity`` or
    above; else it opens the next. A block counts if it has ``min_length`` bases and any identity
    (``strict``: the mean must reach ``min_identity``); its outer elements of under 10 bases are cut off.
    """
    own = with_gaps(records)
    elements = F.array_compact(
        F.array(
            F.struct((F.col("p_align_len") + F.least("gap", F.lit(0))).cast("double").alias("l"), F.col("identity").cast("double").alias("i"), F.col("go_r").alias("r")),
            F.when(F.col("gap") > 0, F.struct(F.col("gap").cast("double").alias("l"), F.lit(0.0).alias("i"), F.lit(None).cast("int").alias("r"))),
        )
    )
    listed = sort_records(own).withColumn("x", F.when(F.col("gap").isNull(), F.array(F.struct(F.col("p_align_len").cast("double").alias("l"), F.col("identity").cast("double").alias("i"), F.col("go_r").alias("r")))).otherwise(elements))
    # One array for each read; a read has few records.
    reads = listed.groupBy("query_name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("go_r", "x"))), lambda s: s["x"])).alias("xs"))
    none = F.array().cast("array<struct<l:double,i:double,r:int>>")
    empty = F.struct(F.array().cast("array<array<struct<l:double,i:double,r:int>>>").alias("done"), none.alias("now"), F.lit(0.0).alias("len"), F.lit(0.0).alias("sum"))

    def good(a):
        return (a["len"] >= min_length) & ((a["sum"] >= min_identity * a["len"]) if strict else (a["sum"] >= min_identity)) & (F.size(a["now"]) > 0)

    def add(a, x):
        joins = (a["len"] == 0) | (a["sum"] + x["i"] * x["l"] >= min_identity * (a["len"] + x["l"]))
        closed = F.when(good(a), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(
            F.when(joins, a["done"]).otherwise(closed).alias("done"),
            F.when(joins, F.concat(a["now"], F.array(x))).otherwise(F.array(x)).alias("now"),
            (F.when(joins, a["len"]).otherwise(0.0) + x["l"]).alias("len"),
            (F.when(joins, a["sum"]).otherwise(0.0) + x["i"] * x["l"]).alias("sum"),
        )

    blocks = F.aggregate("xs", empty, add, lambda a: F.when(good(a), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))

    def trimmed(b):
        """From the first to the last element that is long enough."""
        long_at = F.filter(F.transform(b, lambda x, i: F.when(x["l"] >= MIN_WING, i + 1)), lambda i: i.isNotNull())
        return F.when(F.size(long_at) == 0, none).otherwise(F.slice(b, F.array_min(long_at), F.array_max(long_at) - F.array_min(long_at) + 1))

    kept = reads.select("query_name", F.posexplode(F.filter(F.transform(blocks, trimmed), lambda b: F.size(b) > 0)).alias("at", "b"))
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["l"])
    ident = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["i"] * x["l"])
    return kept.select(
        "query_name", (F.col("at") + 1).alias("block"), total.cast("long").alias("len"), (ident / total).alias("ident"), F.filter(F.transform("b", lambda x: x["r"]), lambda r: r.isNotNull()).alias("records")
    )


def filter_reads(records: DataFrame, min_length: int, min_identity: float, strict: bool = False) -> DataFrame:
    """Records that stay: all of a long and good read, the blocks of a long but worse one (renamed when there are
    several). Record ids stay as they were."""
    placed = sort_records(records)
    totals = by_read(records).filter(F.col("p_align_len") >= min_length)
    whole = placed.join(totals.filter(F.col("p_identity") >= min_identity).select("query_name"), "query_name", "left_semi")
    poor = placed.join(totals.filter(F.col("p_identity") < min_identity).select("query_name"), "query_name", "left_semi")
    blocks = find_blocks(poor.drop("go_r"), min_length, min_identity, strict)
    many = blocks.withColumn("blocks", F.count("*").over(Window.partitionBy("query_name")))
    chosen = many.select("query_name", "block", "blocks", F.explode("records").alias("go_r"))
    renamed = F.when(F.col("blocks") > 1, F.concat("query_name", F.lit("_block"), F.col("block").cast("string"))).otherwise(F.col("query_name"))
    # An overlap with the next record shortens the record itself.
    cut = F.least(F.coalesce(F.lead("q_start").over(Window.partitionBy("query_name").orderBy("go_r")) - F.col("q_end"), F.lit(0)), F.lit(0))
    shortened = poor.withColumn("cut", cut).withColumn("q_end", F.col("q_end") + F.col("cut")).withColumn("p_align_len", F.col("p_align_len") + F.col("cut"))
    if "p_end" in records.columns and "q_strand" in records.columns:
        shortened = shortened.withColumn("p_end", F.col("p_end") + F.when(F.col("q_strand"), F.col("cut")).otherwise(0)).withColumn("p_start", F.col("p_start") - F.when(F.col("q_strand"), 0).otherwise(F.col("cut")))
    parts = shortened.join(chosen, ["query_name", "go_r"]).withColumn("query_name", renamed)
    return whole.select(records.columns).unionByName(parts.select(records.columns))


def auto_identity(reads: DataFrame, target: float, start_length: float = 5000, start_identity: float = 0.95, id_step: float = 0.0005, ln_end: int = 1, ln_step: int = 500, id_end: float | None = None) -> DataFrame:
    """id_adj, ln_adj, diff, total: the thresholds whose kept bases come nearest to ``target`` (first among equals).

    One pass: every read falls into one cell of the grid, and sums over all stricter cells follow from the cells' own.
    """
    steps = max(1, -(-round((1 - start_identity - 0.006 if id_end is None else id_end) * 1e9) // round(id_step * 1e9)))
    lengths = max(1, -(-ln_end // ln_step))
    spark = reads.sparkSession
    cells = spark.range(steps * lengths).select((F.floor(F.col("id") / lengths)).cast("int").alias("i"), (F.col("id") % lengths).cast("int").alias("j"))
    id_cut, ln_cut = F.lit(start_identity) + F.col("i") * id_step, F.lit(float(start_length)) + F.col("j") * ln_step
    # The grid is small and fixed by the arguments; reads are reduced to one row for each distinct pair first.
    few = reads.groupBy("p_align_len", "p_identity").agg(F.count("*").alias("n"))
    got = few.crossJoin(F.broadcast(cells)).groupBy("i", "j").agg(F.sum(F.when((F.col("p_align_len") > ln_cut) & (F.col("p_identity") > id_cut), F.col("p_align_len") * F.col("n")).otherwise(0)).alias("total"))
    diff = F.abs(F.col("total") - F.lit(float(target)))
    return got.select((F.col("i") * id_step).alias("id_adj"), (F.col("j") * ln_step).alias("ln_adj"), diff.alias("diff"), "total").orderBy("diff", "id_adj", "ln_adj").limit(1)


def auto_counts(records: DataFrame, graph_len: DataFrame) -> DataFrame:
    """min_counts for read paths, from depth, mean length and mean identity. ``graph_len`` has one row."""
    one = records.agg(F.avg("p_align_len").alias("m"), (F.sum(F.col("identity") * F.col("p_align_len")) / F.sum("p_align_len")).alias("i"), F.sum("p_align_len").alias("b"))
    depth = -F.log(1 - F.col("i")) * (3 + F.col("m") / 16000)
    return one.crossJoin(F.broadcast(graph_len)).select(F.greatest(F.lit(3), F.ceil(F.col("b") / (F.col("graph_len") * depth) + 1)).cast("long").alias("min_counts"))
