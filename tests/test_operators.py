"""Graph, alignment, model and conflict operators on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import alignments as AL
from strandweave.operators import conflicts as C
from strandweave.operators import graph as G
from strandweave.operators import model as M
from strandweave.operators import pangenome as PG

LINKS = "v1 string, e1 boolean, v2 string, e2 boolean, overlap int"


def graph(spark, names, links):
    s = spark.createDataFrame([(n, 100, 10.0, "ACGT" * 25) for n in names], "name string, len int, cov double, seq string")
    return s, G.symmetric(spark.createDataFrame(links, LINKS))


def test_components(spark):
    s, l = graph(spark, ["1", "2", "3", "4", "5"], [("1", True, "2", False, 0), ("1", False, "3", False, 0), ("3", True, "5", False, 0)])
    got = {r["name"]: r["component"] for r in G.connected_components(s, l).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "5": "1", "4": "4"}


def test_long_chain(spark):
    n = 60
    s, l = graph(spark, [f"{i:03}" for i in range(n)], [(f"{i:03}", True, f"{i + 1:03}", False, 0) for i in range(n - 1)])
    assert {r["component"] for r in G.connected_components(s, l).collect()} == {"000"}


def test_prune_terminal(spark):
    s, l = graph(spark, list("abcd"), [("a", True, "b", False, 0), ("b", True, "a", False, 0), ("b", True, "c", False, 0), ("c", True, "d", False, 0)])
    assert {r["name"] for r in G.prune_terminal(s, l)[0].collect()} == {"a", "b"}


def test_merge_unbranched(spark):
    s, l = graph(spark, list("abc"), [("a", True, "b", False, 4), ("b", True, "c", False, 4)])
    segs, links = G.merge_unbranched(s, l)
    r = segs.collect()
    assert [(x["name"], x["len"], len(x["seq"])) for x in r] == [("a_b_c", 292, 292)] and links.count() == 0


def test_break_and_inner_edges(spark):
    s, l = graph(spark, ["a", "b"], [("a", True, "b", False, 0)])
    segs, links = G.break_contigs(s, l, spark.createDataFrame([("a", 40)], "name string, pos int"))
    assert sorted((r["name"], r["len"]) for r in segs.collect()) == [("a_1", 40), ("a_2", 60), ("b", 100)]
    got = {(r["v1"], r["e1"], r["v2"], r["e2"]) for r in links.collect()}
    assert ("a_1", True, "a_2", False) in got and ("a_2", True, "b", False) in got
    e = spark.createDataFrame([("a", True, 40, "b", True, 61)], "n1 string, e1 boolean, pos1 int, n2 string, e2 boolean, pos2 int")
    segs, links = G.add_inner_edges(s, l, e)
    assert ("a_1", True, "b_2", False) in {(r["v1"], r["e1"], r["v2"], r["e2"]) for r in links.collect()}


def test_trim_refuses_short_contigs(spark):
    s, l = graph(spark, ["a"], [("a", True, "a", False, 120)])
    with pytest.raises(Exception, match="shorter than the overlap"):
        G.trim_overlaps(s, l, 120)[0].collect()


def test_find_blocks(spark):
    rows = [("r", 0, 0, 6000, 6000, 0.999), ("r", 1, 6100, 6200, 100, 0.5), ("r", 2, 6200, 13200, 7000, 0.999)]
    rec = spark.createDataFrame(rows, "query_name string, record_id long, q_start int, q_end int, p_align_len int, identity double")
    got = AL.find_blocks(rec, 5000, 0.99).orderBy("block").collect()
    assert [(r["block"], r["len"], r["records"]) for r in got] == [(1, 6000, [0]), (2, 7100, [1, 2])]  # the poor record opens the second block


def test_mixture():
    m = C.Mixture().fit([100, 101, 99, 100, 500, 501, 499, 500])
    assert list(m.means) == [100, 500] and list(m.predict([98, 505])) == [0, 1]


def test_windows(spark):
    df = spark.createDataFrame([(1, 100), (50, 100), (51, 100), (100, 100), (30, 30)], "b int, n int")
    got = [r[0] for r in df.select(C.windows_of(F.col("b"), F.col("n"))).collect()]
    assert got == [[0], [0], [1, 2] if 100 - 50 <= 50 else [1], [2], [0]]


def test_em_finds_the_optimum():
    rng = np.random.default_rng(1)
    freq = rng.integers(0, 3, (40, 3)).astype(float)
    freq[freq.sum(1) == 0, 0] = 1
    sizes, p = freq.sum(0), np.array([0.5, 0.3, 0.2])  # every start of a variant belongs to one cell
    rate = freq @ p
    x = np.round(rate / rate.sum() * 1e6)
    fit = M.Cells(x, np.ones(40), freq, sizes, [0, 1, 2]).fit([0, 1, 2])
    assert np.allclose(fit.props, p, atol=2e-3)


def test_selection_drops_an_unneeded_variant():
    freq = np.array([[1, 0, 1], [0, 1, 1], [1, 1, 1], [1, 0, 0], [0, 1, 0]], float)
    x = np.array([600, 400, 1000, 600, 400.0])
    fit = M.Cells(x, np.ones(5), freq, np.array([100.0, 100, 100]), [0, 1, 2]).select("BIC")
    assert fit.cids == [0, 1]


def test_blocks_hold_every_step_once():
    a = [("x", True), ("y", True), ("z", True)]
    b = [("x", True), ("y", True), ("w", True)]
    blocks = PG.Blocks([a, b], [False, False], [0.6, 0.4], dict.fromkeys("xyzw", 100)).search()
    steps = sorted((p, v) for bl in blocks for cell in bl for p, v, _ in cell)
    assert steps == [(p, v) for p in (0, 1) for v in range(3)]
    assert max(len(bl) for bl in blocks) == 2


def test_gapped_alignment(spark):
    from strandweave.functions import sequences as S

    df = spark.createDataFrame([("ACGTT", "ACTTA", "2=1I1=1X1D")], "q string, r string, c string")
    assert tuple(df.select(S.gapped(F.col("q"), F.col("r"), F.col("c")).alias("x")).first()["x"]) == ("ACGTT-", "AC-TTA")
    with pytest.raises(Exception, match="unsupported operation"):
        df.select(S.gapped(F.col("q"), F.col("r"), F.lit("2M"))).collect()


def test_combinations():
    assert PG.combinations([2, 3]) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    many = PG.combinations([50, 50, 50], most=100)
    assert len(set(many)) == 100 and many == PG.combinations([50, 50, 50], most=100)


def test_leaks_and_in_between(spark):
    s, l = graph(spark, list("abcdx"), [("a", True, "b", False, 0), ("b", True, "c", False, 0), ("c", True, "d", False, 0), ("b", True, "x", False, 0)])
    step = lambda p: [(n, True) for n in p]
    paths = spark.createDataFrame([(1, step("abc")), (2, step("bcd")), (3, step("ab"))], "pid int, path array<struct<n:string,e:boolean>>")
    assert {r["pid"]: r["closed"] for r in G.no_leak(paths, l).collect()} == {1: False, 2: False, 3: True}
    ends = lambda n: spark.createDataFrame([(n, True)], "name string, e boolean")
    assert {r["name"] for r in G.in_between(l, ends("a"), ends("d")).collect()} == {"b", "c"}


def test_sequential_repeats(spark):
    s, l = graph(spark, list("abcr"), [("a", True, "r", False, 0), ("r", True, "b", False, 0), ("r", True, "c", False, 0), ("b", True, "r", False, 0)])
    assert [(r["name"], r["hops"]) for r in G.sequential_repeats(s, l).collect()] == [("r", 2)]


def test_numbering_is_gapless_and_ordered(spark):
    from strandweave.operators import resample as RS

    rows = RS.numbered(spark.range(500).selectExpr("(id * 37) % 500 AS k").repartition(7), "k").collect()
    assert sorted((r["k"], r["idx"]) for r in rows) == [(i, i) for i in range(500)]
