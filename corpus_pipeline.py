"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, decontaminate, quality, queries, similar, substrings
from strandweave.llm.common import table, written

#: A document stays if its probability of good quality is at least this.
KEEP_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the same rows as the query of operator 4, and from the
    texts of ``docs``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(queries.fold("doc_id", 5) != 0)
    weights = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.score_rows(docs, "text", weights).filter(F.col("out.score") >= KEEP_SCORE).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash candidates whose sets of five-word shingles have a similarity of 0.8 or
    more) one row stays: that of least doc_id (null last), of rows that repeat that id the one whose text has the least
    hash. Null, empty and blank texts are copies of one another; an empty table stays empty."""
    return similar.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat 13 words of a document of smaller id go; documents of which nothing is left go with them. Others
    keep their text as it was."""
    done = substrings.remove_repeats(docs)
    touched = F.size("out.spans") > 0
    text = F.when(touched, F.col("out.kept")).otherwise(F.col("row.text"))
    kept = done.filter(~touched | (F.col("out.n_kept") > 0))
    return kept.select(*[text.alias("text") if c == "text" else F.when(touched, F.length(text)).otherwise(F.col("row.n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of the benchmark occurs go, whether or not its item has an id."""
    found = decontaminate.find_contamination(docs, "text", table(spark, sf_dir, "benchmark"), nameless=True)
    return found.filter(F.size("out.spans") == 0).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether decoding them gives the text again."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode_and_decode(docs.select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN)
    same = F.col("out.decoded") == F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return done.select("row.doc_id", (F.octet_length("out.ids") / 4).cast("long").alias("n_tokens"), "out.ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: A trained network and 64-bit hashes have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
