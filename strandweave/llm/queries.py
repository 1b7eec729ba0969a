"""The contract queries of this folder's operators; ``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, quality, sharding, simhash, substrings, toxicity, url_filter
from .common import table

HOST_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, "url", HOST_RULES + list(url_filter.DEFAULT_PATTERNS))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "pattern")


def op2_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and the least doc_id that links of 2 bits or fewer reach."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(documents)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order, without quotes, with the message it replies to."""
    return chat.link_quotes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def fold(doc_id: str, count: int):
    """crc32 of the id as text, mod ``count``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(count))


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of quality label 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    scored = quality.score_rows(documents, "text", quality.fit(documents, labels))
    return scored.select(F.col("row.doc_id").alias("doc_id"), F.col("out.score").alias("score")).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_seed_and_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that repeat 13 words of a document of smaller id, and the digest of the rest."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.remove_repeats(documents)
    return done.select(
        "row.doc_id",
        "out.n_words",
        (F.col("out.n_words") - F.col("out.n_kept")).alias("n_removed"),
        F.sha2(F.col("out.kept"), 256).alias("kept_sha256"),
    )


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of toxicity label 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 3) != 1)
    scored = toxicity.score_rows(documents, "text", toxicity.fit(documents, labels))
    return scored.select(F.col("row.doc_id").alias("doc_id"), F.col("out.score").alias("score")).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words and items of the benchmark that occur in it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, "text", table(spark, sf_dir, "benchmark"))
    n_hit, items = decontaminate.hit_words(F.col("out.spans")), F.col("out.items")
    return found.select(
        "row.doc_id",
        "out.n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the digests of its token ids and of the decoded bytes."""
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, "text", ranks, pattern).select("row.doc_id", "out.ids")
    decoded = bpe.decode(encoded, "ids", ranks)
    return decoded.select(
        "row.doc_id",
        (F.octet_length("row.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("row.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("out.decoded"), 256).alias("decoded_sha256"),
    )


def op9_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 with near equal bytes, and its slot there."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(documents).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash_vp_trees": op2_simhash_vp_trees,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_byte_cnn_quality": op4_byte_cnn_quality,
    "op5_wu_manber_decontamination": op5_wu_manber_decontamination,
    "op6_seed_and_extend_dedup": op6_seed_and_extend_dedup,
    "op7_string_kernel_toxicity": op7_string_kernel_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_histogram_sort_sharding": op9_histogram_sort_sharding,
    "op10_anisotropic_ann": op10_anisotropic_ann,
}
