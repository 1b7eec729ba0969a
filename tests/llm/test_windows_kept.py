"""Substring dedup keeps the windows it reads twice on the executors' disks, in no table of the shared folder, and drops them."""

import random

from strandweave.llm import substrings
from tests.llm.test_llm import brute_repeats, docs, words


def test_windows_go_to_no_table_and_none_stay(spark, monkeypatch):
    rng = random.Random(7)
    line = words(rng, 20, 9)
    texts = [f"{words(rng, 6)} {line} {words(rng, 6)}" for _ in range(12)]
    ids = rng.sample(range(100), len(texts))
    tables = []
    monkeypatch.setattr(substrings, "written", lambda df, write=substrings.written: tables.append(df.columns) or write(df))
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    done = substrings.remove_repeats(docs(spark, texts, ids))
    got = sorted((r["row"]["doc_id"], r["out"]["n_words"], r["out"]["n_words"] - r["out"]["n_kept"], r["out"]["kept"]) for r in done.collect())
    assert got == sorted((i, *b) for i, b in zip(ids, brute_repeats(texts, ids), strict=True))
    assert sum(n for _, _, n, _ in got) >= 11 * 20
    assert ["w1", "w2", "first"] in tables and ["w1", "w2", "doc"] not in tables
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
