"""Readers. Every format is split into columns by Spark's own functions; .gz files are read as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.sequences import cigar_ops, reverse_complement
from ..operators.graph import known_only, symmetric


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))


def _tags(cols: Column, first: int) -> Column:
    """``XX:t:value`` fields from column ``first`` (from 1) on, as a map."""
    rest = F.filter(F.slice(cols, first, F.greatest(F.size(cols) - first + 1, F.lit(0))), lambda x: x.rlike("^[^:]+:[^:]+:"))
    return F.map_from_entries(F.transform(rest, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)), F.regexp_extract(x, "^[^:]*:[^:]*:(.*)$", 1))))


def _number(tags: Column, *names: str) -> Column:
    """The first tag that is there; negative values count by their absolute value."""
    return F.coalesce(*[F.abs(F.try_element_at(tags, F.lit(n)).cast("double")) for n in names])


def gfa_version(spark: SparkSession, path: str) -> str:
    got = _lines(spark, path).filter(F.col("value").startswith("H\t")).select(F.regexp_extract("value", r"\tVN:Z:([^\t]+)", 1).alias("v")).filter("v <> ''").limit(1).collect()
    return got[0]["v"] if got else "1.0"


def read_gfa(spark: SparkSession, path: str, min_cov: float = 0.0, max_cov: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, half_edges, graph_paths) of a GFA 1 or 2 file.

    Depth is DP or RD, else KC or RC over the length, else 1 (version 2: counts first). The coverage limits apply to
    segments with a depth. A length tag that contradicts the sequence is an error, links of missing segments
    are left out, and an overlap that isn't plain matches is an error.
    """
    two = gfa_version(spark, path).startswith("2")
    cols = _lines(spark, path).select(F.split("value", "\t").alias("c"))
    at = 4 if two else 3
    s = cols.filter(F.get("c", F.lit(0)) == "S").select(F.get("c", F.lit(1)).alias("name"), F.get("c", F.lit(at - 1)).alias("raw"), F.get("c", F.lit(2)).alias("given"), _tags(F.col("c"), at + 1).alias("attrs"))
    told = F.when(F.lit(two), F.col("given").cast("int")).otherwise(F.try_element_at("attrs", F.lit("LN")).cast("int"))
    size = F.when(F.col("raw") == "*", told).otherwise(F.length("raw"))
    wrong = F.raise_error(F.concat(F.lit("length tag contradicts the sequence of "), F.col("name"))).cast("int")
    s = s.withColumn("len", F.when((F.col("raw") != "*") & told.isNotNull() & (told != F.length("raw")), wrong).otherwise(size))
    depth, count = _number(F.col("attrs"), "DP", "RD"), _number(F.col("attrs"), "KC", "RC") / F.col("len")
    s = s.withColumn("depth", F.coalesce(count, depth) if two else F.coalesce(depth, count))
    sum_tag = F.try_element_at("attrs", F.lit("SH"))
    bad = F.raise_error(F.concat(F.lit("checksum contradicts the sequence of "), F.col("name"))).cast("string")
    s = s.withColumn("raw", F.when(sum_tag.isNotNull() & (F.lower(sum_tag) != F.sha2("raw", 256)), bad).otherwise(F.col("raw")))
    kept = F.col("depth").isNull() | ((F.col("depth") >= min_cov) & (F.lit(True) if max_cov is None else F.col("depth") <= max_cov))
    segments = s.filter(kept).select("name", "len", F.coalesce("depth", F.lit(1.0)).alias("cov"), F.when(F.col("raw") != "*", F.col("raw")).alias("seq"), "attrs")
    c = lambda i: F.get("c", F.lit(i))
    if two:  # E id ref1± ref2± beg1 end1 beg2 end2 alignment
        rows = cols.filter(c(0) == "E").select(F.regexp_replace(c(2), "[+-]$", "").alias("v1"), c(2).endswith("+").alias("e1"), F.regexp_replace(c(3), "[+-]$", "").alias("v2"), c(3).endswith("-").alias("e2"), c(8).alias("ov"))
    else:
        rows = cols.filter(c(0) == "L").select(c(1).alias("v1"), (c(2) == "+").alias("e1"), c(3).alias("v2"), (c(4) == "-").alias("e2"), c(5).alias("ov"))
    number = F.regexp_extract("ov", r"^(\d+)M$", 1)
    plain = F.when(F.col("ov").isin("*", "0"), F.lit(0)).when(number == "", F.raise_error(F.concat(F.lit("unsupported overlap "), F.col("ov"))).cast("int")).otherwise(number.try_cast("int"))
    links = symmetric(known_only(rows.withColumn("overlap", plain).drop("ov"), segments))
    p = cols.filter(c(0) == "P").select(c(1).alias("label"), P.parse_bandage(c(2)).alias("path"), _tags(F.col("c"), 5).alias("t"))
    return segments, links, p.select("label", "path", F.try_element_at("t", F.lit("pp")).cast("double").alias("prop"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """label, seq: entries may span lines."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    return rows.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("label"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def read_fastg(spark: SparkSession, path: str, min_cov: float = 0.0, max_cov: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, half_edges): labels ``EDGE_name_length_n_cov_x['][:next,…];``. The overlap is the largest odd k from 21
    to 127 with which all neighbours agree, else 0."""
    entry = read_fasta(spark, path).withColumn("label", F.regexp_replace("label", ";$", ""))
    head = F.split_part("label", F.lit(":"), F.lit(1))
    pick = lambda x, i: F.regexp_extract(x, r"^EDGE_(.+)_length_(\d+)_cov_([0-9.eE+-]+)('?)$", i)
    rows = entry.select(pick(head, 1).alias("name"), pick(head, 3).cast("double").alias("cov"), (pick(head, 4) == "").alias("fwd"), F.col("seq"), F.expr("substring_index(label, ':', -1)").alias("next"), F.col("label").contains(":").alias("linked"))
    kept = (F.col("cov") >= min_cov) & (F.lit(True) if max_cov is None else F.col("cov") <= max_cov)
    segments = rows.filter("fwd").filter(kept).select("name", F.length("seq").alias("len"), "cov", "seq")
    far = rows.filter("linked").select(F.col("name").alias("v1"), F.col("fwd").alias("e1"), F.explode(F.split("next", ",")).alias("x"))
    links = known_only(far.select("v1", "e1", pick(F.col("x"), 1).alias("v2"), (pick(F.col("x"), 4) != "").alias("e2"), F.lit(0).alias("overlap")), segments)
    seqs = segments.select("name", "seq")
    turn = lambda e: F.when(F.col(e), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    pair = links.join(seqs.withColumnRenamed("name", "v1"), "v1").withColumn("a", turn("e1")).drop("seq").join(seqs.withColumnRenamed("name", "v2"), "v2").withColumn("b", F.when(F.col("e2"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    tries = pair.select(F.explode(F.sequence(F.lit(21), F.lit(127), F.lit(2))).alias("k"), "a", "b").select("k", ((F.length("a") >= F.col("k")) & (F.length("b") >= F.col("k")) & (F.right("a", F.col("k")) == F.left("b", F.col("k")))).alias("ok"))
    best = tries.groupBy("k").agg(F.bool_and("ok").alias("ok")).filter("ok").agg(F.coalesce(F.max("k"), F.lit(0)).alias("k"))
    return segments, symmetric(links.crossJoin(F.broadcast(best)).withColumn("overlap", F.col("k")).drop("k"))


def alignment_format(path: str) -> str:
    """``gaf`` or ``tsv`` from the file's suffix."""
    for kind in ("gaf", "tsv"):
        if path.endswith((f".{kind}", f".{kind}.gz")):
            return kind
    raise ValueError(f"unknown alignment format: {path}")


def read_gaf(spark: SparkSession, path: str, min_record_identity: float = 0.0) -> DataFrame:
    """Alignment records of at least this identity (tag ``id``, else matches over alignment length). Record ids follow the
    order of the lines in one file and are unique over several."""
    cols = _lines(spark, path).filter("value <> ''").select(F.monotonically_increasing_id().alias("record_id"), F.split("value", "\t").alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    rows = cols.select("record_id", c(0).alias("query_name"), c(1).cast("int").alias("query_len"), c(2).cast("int").alias("q_start"), c(3).cast("int").alias("q_end"), (c(4) == "+").alias("q_strand"), c(5).alias("path_str"), P.parse_gaf(c(5)).alias("path"), c(6).cast("int").alias("p_len"), c(7).cast("int").alias("p_start"), c(8).cast("int").alias("p_end"), c(9).cast("int").alias("num_match"), c(10).cast("int").alias("align_len"), c(11).cast("int").alias("mapq"), _tags(F.col("c"), 13).alias("tags"))
    made = rows.withColumn("p_align_len", F.col("p_end") - F.col("p_start")).withColumn("cigar", cigar_ops(F.try_element_at("tags", F.lit("cg")))).withColumn("identity", F.coalesce(F.try_element_at("tags", F.lit("id")).cast("double"), F.col("num_match") / F.col("align_len")))
    return made.filter(F.col("identity") >= min_record_identity)


def read_spa_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of the nine-column format; rows with several parts (a comma in column two) are left out. There
    is no identity: null passes every identity filter."""
    cols = _lines(spark, path).filter("value <> ''").select(F.monotonically_increasing_id().alias("record_id"), F.split("value", "\t").alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    rows = cols.filter(~c(1).contains(","))
    lens = F.transform(F.split(c(7), ","), lambda x: x.cast("int"))
    out = rows.select("record_id", c(0).alias("query_name"), c(5).cast("int").alias("query_len"), c(1).cast("int").alias("q_start"), c(2).cast("int").alias("q_end"), c(3).cast("int").alias("p_start"), c(4).cast("int").alias("p_end"), P.parse_bandage(c(6)).alias("path"), F.aggregate(lens, F.lit(0), lambda a, x: a + x).alias("p_align_len"))
    return out.withColumn("align_len", F.greatest("p_align_len", F.abs(F.col("q_start") - F.col("q_end")) + 1)).withColumn("identity", F.lit(None).cast("double"))


def read_alignments(spark: SparkSession, path: str, min_record_identity: float = 0.0) -> DataFrame:
    return read_gaf(spark, path, min_record_identity) if alignment_format(path) == "gaf" else read_spa_tsv(spark, path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """query_name, seq: four lines a record. Lines are numbered by file block: a row's place in its block, plus the lines
    of the file's earlier blocks."""
    rows = spark.read.text(path).select(F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("m"), F.regexp_replace("value", "\r$", "").alias("v"))
    blocks = rows.groupBy("f", "b").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.join(blocks.select("f", "b", "first", ahead.alias("ahead")), ["f", "b"]).withColumn("i", F.col("ahead") + F.col("m") - F.col("first"))
    got = at.groupBy("f", F.floor(F.col("i") / 4).alias("r")).agg(F.max(F.when(F.col("i") % 4 == 0, F.col("v"))).alias("h"), F.max(F.when(F.col("i") % 4 == 1, F.col("v"))).alias("seq"))
    return got.filter(F.col("h").startswith("@")).select(F.regexp_extract("h", r"^@(.*)$", 1).alias("query_name"), "seq")


def read_user_paths(spark: SparkSession, path: str) -> DataFrame:
    """ord, path: a path a line, ``53+,45-(circular)`` or ``>53<45``."""
    rows = _lines(spark, path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("s")).filter("s <> ''")
    return rows.select("ord", F.when(F.col("s").rlike("^[><]"), P.parse_gaf(F.col("s"))).when(F.col("s").rlike(r"[+-]"), P.parse_bandage(F.col("s"))).otherwise(F.raise_error(F.concat(F.lit("not a path: "), F.col("s"))).cast("array<struct<n:string,e:boolean>>")).alias("path"))


def read_locus_tab(spark: SparkSession, path: str, segments: DataFrame, type_factor: float = 3.0) -> DataFrame:
    """name, kind, locus, weight: annotations ``locus(start-end,kind)>>…`` of contigs. Of a locus on several contigs the
    heaviest stays (bases times coverage), and kinds of under 1 / ``type_factor`` of a contig's main kind go."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path)
    a, f = rows.columns[0], rows.columns[5]
    got = rows.select(F.col(f"`{a}`").alias("name"), F.explode(F.split(F.col(f"`{f}`"), ">>")).alias("x")).select("name", *[F.regexp_extract("x", r"^(.*)\((\d+)-(\d+),([^)]*)\)$", i).alias(n) for i, n in ((1, "locus"), (2, "s"), (3, "t"), (4, "kind"))]).filter("locus <> ''")
    held = got.join(segments.select("name", "cov"), "name").withColumn("weight", (F.abs(F.col("t").cast("int") - F.col("s").cast("int")) + 1) * F.col("cov"))
    best = held.withColumn("k", F.row_number().over(Window.partitionBy("kind", "locus").orderBy(F.desc("weight"), "name"))).filter("k = 1")
    kinds = best.groupBy("name", "kind").agg(F.sum("weight").alias("kw")).withColumn("top", F.max("kw").over(Window.partitionBy("name"))).filter(F.col("kw") * type_factor >= F.col("top"))
    return best.join(kinds.select("name", "kind"), ["name", "kind"], "left_semi").select("name", "kind", "locus", "weight")


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate variants of an earlier run, from its Parquet checkpoint."""
    return spark.read.parquet(path)
