"""Faults that earlier tests didn't see: joins on ordinary pieces, repeated rows in training, long batches, plain-loop models."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandweave.llm import ann, bpe, common, decontaminate, quality, sharding, substrings, toxicity
from strandweave.llm.queries import QUERIES
from tests.llm.test_llm import corpus, docs, toxic_corpus, words

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- 8 ---


@tables
def test_joins_make_the_ids_of_ordinary_documents(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import regex

    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    split = regex.compile(public_tokenizers.PATTERN)
    pieces = {p.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for p in split.findall(r["text"] or "")}
    split_ones = [p for p in pieces if p not in ranks]
    joined = 0
    for p in split_ones:
        e = bpe.Encoder(ranks)
        assert e.piece(p) == e.merge(p)
        joined += e.joins > 0
    assert len(split_ones) > 100 and joined == len(split_ones)


def test_halves_are_remembered_within_bounds(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "MEMO", 20)
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    e, rng = bpe.Encoder(ranks), random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abcdefxyz ") for _ in range(rng.randint(1, 60))).encode()
        assert e.half(p) == e.merge(p)
        assert len(e.halves) <= 20 and len(e.pairs) <= 20
    assert e.half(b"ab" * 20_000) == e.join(e.half(b"ab" * 10_000), e.half(b"ab" * 10_000))


# --- batches ---


def test_batches_are_bounded_and_tighter_bounds_stay(spark):
    rows, size = common.BATCH
    old = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        spark.conf.set(rows, "7")
        spark.conf.set(size, "100000000")
        common.small_batches(spark)
        assert spark.conf.get(rows) == "7" and int(spark.conf.get(size).rstrip("b")) == common.BATCH[size]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v.rstrip("b"))


# --- 4 and 7 ---


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_repeated_rows_are_learned_from_once(spark, module, label):
    df = docs(spark, ["one text"] * 6 + ["b text", "both", "a text", None], [1] * 6 + [2, 3, 2, 4])
    labels = spark.createDataFrame([(1, 1)] * 6 + [(2, 0), (3, 1), (3, 0), (4, 1), (5, 0), (None, 1), (2, None)], f"doc_id long, {label} int")
    got = module.training_rows(df, "text", "doc_id", labels, label, 100, 1000)
    assert got == [("one text", 1), ("a text", 0)]
    assert module.training_rows(df.filter("false"), "text", "doc_id", labels, label, 100, 1000) == []


def plain_quality(w, text):
    """The network by plain loops over bytes, blocks and chunks."""
    data, blocks = quality.padded(quality.as_bytes(text))
    pooled = quality.block_pool(w, data, blocks)
    n_filters = pooled.shape[1]
    for b in range(blocks):
        for f in range(0, n_filters, max(1, n_filters // 3)):
            best = max(sum(float(w["table"][k][data[b * quality.BLOCK + i + k], f]) for k in range(quality.WIDTH)) for i in range(quality.BLOCK))
            assert np.isclose(best, pooled[b, f], atol=1e-4)


def test_filters_by_plain_loops():
    w = quality.start_weights(np.random.default_rng(3))
    for text in ("", "short", "x" * 700, words(random.Random(2), 120)):
        plain_quality(w, text)


def test_filter_gradients():
    w = {k: v.astype(np.float64) for k, v in quality.start_weights(np.random.default_rng(0)).items()}
    data = np.random.default_rng(1).integers(32, 120, 400).astype(np.uint8)
    g = {k: np.zeros_like(x) for k, x in w.items()}
    quality.gradients(w, data, 1, g)
    text, flat = bytes(data).decode(), np.abs(g["table"]).ravel()
    for place in np.argsort(-flat)[[0, 3, 10, 40]]:
        i = np.unravel_index(place, g["table"].shape)
        old, e = w["table"][i], 1e-4
        w["table"][i] = old + e
        up = -np.log(quality.score(w, text))
        w["table"][i] = old - e
        down = -np.log(quality.score(w, text))
        w["table"][i] = old
        assert abs((up - down) / (2 * e) - g["table"][i]) < 0.05 * max(1e-3, abs(g["table"][i]))


def test_spoilt_insults_reach_the_threshold(spark):
    """Held-out recall of both classes, and of insults with a character put in, at the threshold of the query."""
    rows = toxic_corpus()
    w = toxicity.train([t for t, _ in rows[:200]], [y for _, y in rows[:200]])
    held = rows[200:]
    hit = lambda texts: np.mean([toxicity.score(w, t) >= 0.7 for t in texts])
    spoil = lambda t, c: " ".join(f"{x[:3]}{c}{x[3:]}" if x in ("moron", "worthless", "pathetic") else x for x in t.split())
    toxic = [t for t, y in held if y]
    assert hit(toxic) >= 0.9 and hit([t for t, y in held if not y]) <= 0.05
    assert hit([spoil(t, "x") for t in toxic]) >= 0.6 and hit([spoil(t, "-") for t in toxic]) >= 0.6


# --- 5 ---


def test_searcher_tables_are_small_and_shift():
    items = [(str(i), words(random.Random(i), 400, 3000)) for i in range(100)]
    p = decontaminate.Patterns(items, 10)
    tool = p.tools[-1]
    assert tool.m == 10 and sum(x.nbytes for x in (tool.starts, tool.owner, tool.window, tool.used, tool.first)) + len(tool.shift) < 4_000_000
    looked = []

    class Words(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    other = Words(f"v{i}".encode() for i in range(9000))
    assert list(tool.search(other, p.number)) == [] and len(looked) <= 2 * 9000 / 8


def test_items_that_share_windows(spark):
    shared = words(random.Random(3), 12, 900)
    bench = spark.createDataFrame([(i, f"{shared} tail{i}") for i in range(30)] + [(99, "tail1 tail2")], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, [f"x {shared} y", f"{shared} tail7", "tail1 tail2"]), "text", bench).select("row.doc_id", "out.items").collect()
    by = {r["doc_id"]: r["items"] for r in got}
    assert len(by[0]) == 30 and len(by[1]) == 30 and by[2] == ["99"]


# --- 9 ---


@tables
def test_shards_recounted(spark):
    """Every document once; shards cut the key order at equal shares of the bytes, recounted by plain loops."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op9_histogram_sort_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["grown_shard"] is None for r in got)
    order = sorted(got, key=lambda r: (r["text_crc32"], r["doc_id"]))
    assert [(r["shard"], r["slot"]) for r in order] == sorted((r["shard"], r["slot"]) for r in got)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(abs(sums[k] - total / 16) <= 2 * most for k in range(16))


# --- ids, extra columns, stages ---


def test_ids_that_are_no_numbers_are_refused(spark):
    text_ids = spark.createDataFrame([("a", "x y z"), ("b", "x y z")], "doc_id string, text string")
    for call in (lambda: substrings.remove_repeats(text_ids), lambda: sharding.shard_rows(text_ids), lambda: ann.search(text_ids.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), F.lit(True))):
        with pytest.raises(TypeError, match="whole numbers"):
            call()


def test_search_with_clashing_columns(spark):
    rows = [(i, [float(i % 5), 1.0 + i], "x", 1, 2.0, 3) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, rank int, score double, query_id int")
    got = ann.search(df, F.col("vec_id") == 0).collect()
    assert len(got) == 20 and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))


def stage_inputs(spark, tmp_path):
    """Null ids and texts, repeated ids, ties, empty and long texts and extra columns; labels and a benchmark beside them."""
    rng = random.Random(4)
    texts = [*corpus()[:25], None, "", " ", "tie", "tie", words(rng, 4000, 3000), "alpha beta gamma"]
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    df = docs(spark, texts, ids).withColumn("n_chars", F.length("text").cast("long")).withColumn("name", F.lit("n")).withColumn("found", F.lit(2))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma"), (None, None)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    return df


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_take_odd_rows(spark, tmp_path, name, stage):
    df = stage_inputs(spark, tmp_path)
    key = lambda r: str([r[c] for c in df.columns if c not in ("text", "n_chars")])
    got = stage(spark, df, str(tmp_path))
    assert got.columns == df.columns
    rows, all_keys = got.collect(), [key(r) for r in df.collect()]
    assert 0 < len(rows) <= len(all_keys) and all(all_keys.count(key(r)) >= [key(x) for x in rows].count(key(r)) for r in rows)
    if name == "benchmark_decontamination":
        assert len(rows) == len(all_keys) - 1
    assert stage(spark, df.filter("false"), str(tmp_path)).count() == 0


def test_last_stage_takes_odd_rows(spark, tmp_path):
    df = stage_inputs(spark, tmp_path)
    pytest.importorskip("public_tokenizers")
    got = corpus_pipeline.byte_bpe(spark, df, str(tmp_path)).collect()
    assert len(got) == df.count() and all(r["round_trip"] for r in got)
    assert corpus_pipeline.byte_bpe(spark, df.filter("false"), str(tmp_path)).count() == 0
