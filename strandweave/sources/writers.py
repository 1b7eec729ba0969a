"""Writers: lines are made by Spark; a file format that must be one file is written from one sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.sequences import fastg_name, reverse_complement, wrapped


def gfa_lines(segments: DataFrame, links: DataFrame, graph_paths: DataFrame | None = None) -> DataFrame:
    """part, key, value: header, segments, each link once, paths (label, path, circular, prop)."""
    spark = segments.sparkSession
    head = spark.createDataFrame([(0, "", "H\tVN:Z:1.0")], "part int, key string, value string")
    s = segments.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("len").cast("string")), F.concat(F.lit("RC:i:"), (F.col("len") * F.col("cov")).cast("long").cast("string"))).alias("value"))
    sign = lambda x: F.when(x, "+").otherwise("-")
    one = links.filter(F.struct("v1", F.col("e1").alias("x")) <= F.struct(F.col("v2").alias("v1"), F.col("e2").alias("x")))
    l = one.select(F.lit(2).alias("part"), F.concat_ws("\t", "v1", F.col("e1").cast("string"), "v2", F.col("e2").cast("string")).alias("key"), F.concat_ws("\t", F.lit("L"), "v1", sign(F.col("e1")), "v2", sign(~F.col("e2")), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    out = head.union(s).union(l)
    if graph_paths is not None:
        from ..operators.variants import measured

        own = measured(graph_paths, segments, links, "label")
        overlaps = F.transform(F.when(F.col("circular"), F.col("ovs")).otherwise(F.slice("ovs", F.lit(1), F.size("ovs") - 1)), lambda x: F.concat(x.cast("string"), F.lit("M")))
        p = own.select(F.lit(3).alias("part"), F.col("label").alias("key"), F.concat_ws("\t", F.lit("P"), "label", P.to_bandage(F.col("path"), F.lit(False)), F.when(F.size(overlaps) > 0, F.array_join(overlaps, ",")).otherwise("*"), F.concat(F.lit("pp:f:"), F.col("prop").cast("string"))).alias("value"))
        out = out.union(p)
    return out


def write_lines(lines: DataFrame, path: str, compression: str | None = None, one: bool = True) -> None:
    """Lines (part, key, value) in order in the folder ``path``: one text file, or, for what grows with the reads, several
    whose names are in order too."""
    made = (lines.repartition(1) if one else lines.repartitionByRange("part", "key")).sortWithinPartitions("part", "key").select("value")
    made.write.mode("overwrite").text(path, compression=compression) if compression else made.write.mode("overwrite").text(path)


def fasta_lines(seqs: DataFrame, width: int = 70) -> DataFrame:
    """seqs: label, seq."""
    return seqs.select(F.lit(0).alias("part"), F.col("label").alias("key"), F.concat(F.lit(">"), "label", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def fastg_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Both strands of every contig with the names of what follows."""
    names = segments.select("name", fastg_name(F.col("name"), F.col("len"), F.col("cov")).alias("long"))
    far = links.join(names.select(F.col("name").alias("v2"), "long"), "v2").groupBy(F.col("v1").alias("name"), F.col("e1").alias("fwd")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("long", F.when(F.col("e2"), "'").otherwise("")))), ",").alias("nexts"))
    both = segments.join(names, "name").select("name", "long", "seq", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd")).join(far, ["name", "fwd"], "left")
    label = F.concat(F.lit(">"), "long", F.when(F.col("fwd"), "").otherwise("'"), F.when(F.col("nexts").isNotNull(), F.concat(F.lit(":"), "nexts")).otherwise(""), F.lit(";"))
    return both.select(F.lit(0).alias("part"), F.concat("name", F.when(F.col("fwd"), "0").otherwise("1")).alias("key"), F.concat(label, F.lit("\n"), F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))).alias("value"))


def gaf_lines(records: DataFrame) -> DataFrame:
    tags = F.concat(F.lit("id:f:"), F.col("identity").cast("string"))
    text = lambda c: F.col(c).cast("string")
    return records.select(F.lit(0).alias("part"), F.lpad(F.col("record_id").cast("string"), 20, "0").alias("key"), F.concat_ws("\t", "query_name", text("query_len"), text("q_start"), text("q_end"), F.when(F.col("q_strand"), "+").otherwise("-"), P.to_gaf(F.col("path")), text("p_len"), text("p_start"), text("p_end"), text("num_match"), text("align_len"), text("mapq"), tags).alias("value"))


def variant_info(fids: DataFrame, variants: DataFrame, groups: DataFrame) -> DataFrame:
    """FID, CID, Unidentifiable_to_cid, CONTIGS, BASES, PATH. variants: cid, path, circular, size."""
    others = groups.filter("cid <> representative").groupBy(F.col("representative").alias("cid")).agg(F.array_join(F.array_sort(F.collect_list(F.col("cid").cast("int"))).cast("array<string>"), ",").alias("u"))
    got = variants.join(fids, "cid", "left").join(others, "cid", "left")
    return got.select(F.coalesce(F.col("fid").cast("string"), F.lit("*")).alias("FID"), F.col("cid").alias("CID"), F.coalesce("u", F.lit("*")).alias("Unidentifiable_to_cid"), F.size("path").alias("CONTIGS"), F.col("size").alias("BASES"), P.to_bandage(F.col("path"), F.col("circular")).alias("PATH"))


def readpath_info(counts: DataFrame, subs: DataFrame, fids: list[int]) -> DataFrame:
    """path, num_reads and a column fid_N for each variant with the path's occurrences in it. subs: fid, path, freq."""
    wide = subs.groupBy("path").pivot("fid", fids).agg(F.first("freq"))
    got = counts.join(wide, "path", "left")
    return got.select(P.to_gaf(F.col("path")).alias("path"), *[F.coalesce(F.col(str(f)), F.lit(0)).alias(f"fid_{f}") for f in fids], F.col("n").alias("num_reads"))


def result_table(solutions: DataFrame, props: DataFrame, fids: list[int]) -> DataFrame:
    """SOLUTIONS, BOOTSTRAP_SUPPORT, LOGLIKELIHOOD, criterion and a frequency for each FID. props: solution, fid, prop."""
    wide = props.groupBy("solution").pivot("fid", fids).agg(F.first("prop"))
    return solutions.join(wide, "solution", "left").select(*solutions.columns, *[F.when(F.col(str(f)).isNull(), "-").otherwise(F.format_string("%.4f", F.col(str(f)))).alias(f"fid_{f}") for f in fids])


def replicate_table(props: DataFrame, fids: list[int]) -> DataFrame:
    """A row for each replicate with every variant's share."""
    wide = props.groupBy("rep").pivot("fid", fids).agg(F.first("prop"))
    return wide.select(F.col("rep"), *[F.coalesce(F.col(str(f)), F.lit(0.0)).alias(f"fid_{f}") for f in fids])


def save_candidates(variants: DataFrame, path: str) -> None:
    variants.write.mode("overwrite").parquet(path)


def record_ids(numbered: DataFrame, reads: DataFrame) -> DataFrame:
    """rp_id, record_id (a comma list, rising). numbered: idx, path; reads: record_id, path."""
    held = reads.join(numbered, "path").groupBy("idx").agg(F.array_join(F.array_sort(F.collect_list("record_id")).cast("array<string>"), ",").alias("record_id"))
    return held.select(F.col("idx").alias("rp_id"), "record_id")


def variant_fasta(seqs: DataFrame) -> DataFrame:
    """file and value: a file for each chosen variant with all variants that can't be told from it. seqs: place (of the chosen
    variant, from 0), fid, prop (of all of them), seq, sub (place within the file, from 0), many (how many there are), uid."""
    freq = F.when(F.col("many") > 1, F.lit("freq<=")).otherwise(F.lit("freq="))
    uid = F.concat(F.lit("uid="), F.col("uid").cast("string"), F.when(F.col("many") > 1, F.concat(F.lit("."), F.col("sub").cast("string"))).otherwise(""))
    label = F.concat_ws(" ", F.concat(F.lit(">"), F.col("fid").cast("string")), F.concat(freq, F.format_string("%.4f", "prop")), F.format_string("len=%dbp", F.length("seq")), uid)
    return seqs.select(F.format_string("variant.%04d.fasta", F.col("place").cast("int")).alias("file"), "sub", F.concat(label, F.lit("\n"), "seq").alias("value"))
