"""Operators that were rewritten to stay linear, against plain loops; and the plans of the dear queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import sequences as S
from strandweave.functions import stats as T
from strandweave.operators import bins as B
from strandweave.operators import graph as G
from strandweave.operators import pangenome as PG
from strandweave.operators import resample as RS
from strandweave.operators import statistics as ST
from strandweave.operators import variants as V
from strandweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PATH = "array<struct<n:string,e:boolean>>"


def plain_frames(seq, threshold):
    best = None
    for f in range(3):
        done, now = [], 0
        for i in range(f, len(seq), 3):
            codon = seq[i : i + 3]
            if now and codon in S.STOP_CODONS:
                done, now = done + [now] * (now >= threshold), 0
            elif now:
                now += 3
            elif codon in S.START_CODONS:
                now = 3
        done += [now] * (now > 0)
        if best is None or sum(done) > sum(best):
            best = done
    return best


def test_reading_frames(spark):
    rng = random.Random(1)
    seqs = ["", "A", "AT", "ATG", "ATGTAA", "TAATAG", *["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 700))) for _ in range(40)]]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string").select("i", S.orf_lengths(F.col("s"), 30).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: plain_frames(s, 30) for i, s in enumerate(seqs)}


def test_transitions_across_pieces(spark, monkeypatch):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (1, 3, 4, 7, 8, 40, 101)]
    want = {}
    for s in seqs:
        for i in range(len(s) - 3):
            stands = S.DEGENERATE[s[i + 3]]
            for b in stands:
                want[s[i : i + 3], b] = want.get((s[i : i + 3], b), 0) + 1 / len(stands)
    for piece in (1 << 16, 4, 7):
        monkeypatch.setattr(ST, "PIECE", piece)
        got = {(r["kmer"], r["base"]): r["n"] for r in ST.transitions(spark.createDataFrame([(s,) for s in seqs], "seq string"), 3).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def canonical(p):
    return min(p, tuple((n, not e) for n, e in reversed(p)))


@pytest.mark.parametrize("longest", [5, 30, 90])
def test_sub_paths(spark, longest):
    rng = random.Random(3)
    rows, want = [], {}
    for cid in range(12):
        n = rng.randint(1, 7)
        path = [(rng.choice("abc"), rng.random() < 0.5) for _ in range(n)]
        lens, ovs, ring = [rng.randint(4, 20) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)], rng.random() < 0.5
        rows.append((cid, path, ring, lens, ovs))
        turns = -(-longest // max(1, sum(lens) - sum(ovs))) + 2 if ring else 1
        p, ls, os_ = path * turns, lens * turns, ovs * turns
        for i in range(n):
            for k in range(1, len(p) - i + 1):
                inner = sum(ls[j] - os_[j - 1] for j in range(i + 1, i + k - 1))
                if k <= 2 or inner <= longest - 2:
                    key = (cid, canonical(tuple(p[i : i + k])))
                    want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(rows, f"cid int, path {PATH}, circular boolean, lens array<bigint>, ovs array<bigint>")
    got = {(r["cid"], tuple(map(tuple, r["path"]))): r["freq"] for r in V.sub_paths(df, longest).collect()}
    assert got == want


def test_cells(spark):
    rng = random.Random(4)
    paths = {c: rng.randint(1, 4) for c in "abcdefgh"}
    desc, facts = [], {}
    for p, steps in paths.items():
        full, inner = rng.randint(20, 60), rng.randint(0, 15)
        left, right = rng.randint(1, 12), rng.randint(1, 12)
        lo, hi = (inner + 2, full) if steps > 1 else (1, full)
        facts[p] = (steps, full, inner, left, right, lo, hi)
        desc.append((p, steps, full, inner, left if steps > 1 else None, right if steps > 1 else None, lo, hi))
    reads = [(rng.choice("abcdefghxy"), rng.randint(1, 75), rep) for rep in (1, 2) for _ in range(400)]
    d = spark.createDataFrame(desc, "path string, steps int, full_len bigint, inner_len bigint, left_free bigint, right_free bigint, lo bigint, hi bigint")
    r = spark.createDataFrame(reads, "path string, len int, rep int").withColumn("n", F.lit(1).cast("long"))

    def plain(own):
        cuts = sorted({f[5] for f in facts.values()} | {f[6] + 1 for f in facts.values()})
        bins = [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if any(a <= n < b for _, n in own)]
        out = {}
        for i, (a, b) in enumerate(bins, 1):
            inside = [(p, n) for p, n in own if a <= n <= b]
            for p in {p for p, _ in inside} & set(facts):
                steps, full, inner, left, right, _, _ = facts[p]
                x = []
                for _, n in inside:
                    most = n - (inner + 2) + 1
                    x.append(full - n + 1 if steps == 1 else most - max(most - left, 0) - max(most - right, 0))
                out[i, p] = (sum(q == p for q, _ in inside), sum(x) / len(x))
        return out

    one = r.filter("rep = 1").drop("rep")
    got = {(x["bin_id"], x["path"]): (x["num_matched"], x["num_possible_x"]) for x in B.cells(B.placed_lengths(d, one), d, one).collect()}
    want = plain([(p, n) for p, n, rep in reads if rep == 1])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    both = d.crossJoin(spark.createDataFrame([(1,), (2,)], "rep int"))
    rows = B.cells(B.placed_lengths(both, r, ("rep",)), both, r, ("rep",)).collect()
    for rep in (1, 2):
        want = plain([(p, n) for p, n, x in reads if x == rep])
        got = {(x["bin_id"], x["path"]): (x["num_matched"], x["num_possible_x"]) for x in rows if x["rep"] == rep}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert B.cells(B.placed_lengths(d, one.filter("false")), d, one.filter("false")).count() == 0


def test_floor_in(spark):
    rng = random.Random(5)
    breaks, seeks = rng.sample(range(1000), 60), [*range(0, 1100, 7), 5000]
    at = sorted(breaks)
    for width in (8, 1024):
        got = {r["k"]: (r["idx"], r["gap"]) for r in T.floor_in(spark.createDataFrame([(s,) for s in seeks], "k long"), "k", spark.createDataFrame([(b,) for b in breaks * 2], "b long"), "b", width).collect()}
        for s in seeks:
            low = [b for b in at if b <= s]
            assert got[s] == (len(low) - 1, s - low[-1] if low else None)


def test_jackknife_leaves_out_exactly(spark):
    got = RS.jackknife(spark.range(5000).withColumnRenamed("id", "idx"), 3, 777).groupBy("rep").count().collect()
    assert sorted((r["rep"], r["count"]) for r in got) == [(1, 4223), (2, 4223), (3, 4223)]


def test_bootstrap_stops_when_no_solution_can_reach_its_support():
    assert RS.last_useful([(1,), (1,), (2,)], 100, 0.95) == (3, True)
    assert RS.last_useful([(1,), (2,), (3,), (1,)], 10, 0.85) == (3, False) and RS.last_useful([], 10, 0.9) == (0, True)


def test_replicates_go_on_where_they_ended(spark):
    idx = spark.range(50).withColumnRenamed("id", "idx")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(RS.bootstrap(idx, 5)) == sorted(rows(RS.bootstrap(idx, 2)) + rows(RS.bootstrap(idx, 3, first=3)))


def test_split_palindromes(spark):
    """x and y link to both ends of p (pruned), z to both ends of q (kept), three to both ends of r (a repeat)."""
    segments = spark.createDataFrame([(n, 4, 1.0, "ACGT" if n in "pqr" else "AACC") for n in "pqrxyzuvw"], "name string, len int, cov double, seq string")
    ends = [("p", "x"), ("p", "y"), ("q", "z"), ("r", "u"), ("r", "v"), ("r", "w")]
    links = G.symmetric(spark.createDataFrame([(a, e, b, False, 1) for a, b in ends for e in (True, False)], "v1 string, e1 boolean, v2 string, e2 boolean, overlap int"))
    left, repeats = G.split_palindromes(segments, links)
    got = {(r["v1"], r["e1"], r["v2"]) for r in left.collect() if r["v1"] in "pqr"}
    assert {x for x in got if x[0] == "p"} == {("p", False, "x"), ("p", True, "y")}
    assert len([x for x in got if x[0] == "q"]) == 2 and len([x for x in got if x[0] == "r"]) == 6
    assert [r["name"] for r in repeats.collect()] == ["r"] and left.exceptAll(G.symmetric(left)).count() == 0


def test_blocks_of_unrelated_variants(spark):
    """Variants without a common contig are searched apart, and their blocks are numbered on."""
    rows = [(0, [("a", True), ("b", True)], False), (1, [("a", True), ("b", True)], False), (2, [("x", True), ("y", False)], False), (3, [("y", True), ("z", True)], True)]
    v = spark.createDataFrame(rows, f"cid int, path {PATH}, circular boolean")
    seg = spark.createDataFrame([(n, 10) for n in "abxyz"], "name string, len int")
    got = PG.colinear_blocks(v, v.select("cid", F.lit(0.25).alias("prop")), seg).collect()
    assert len({(r["cid"], r["vid"]) for r in got}) == len(got) == 8
    ids = {r["block_id"] for r in got}
    assert ids == set(range(len(ids)))
    assert {r["block_id"] for r in got if r["cid"] < 2}.isdisjoint({r["block_id"] for r in got if r["cid"] > 1})


@tables
@pytest.mark.parametrize("name", ["bin_cells", "loglik_at_uniform", "path_in_graph"])
def test_plans_share_their_inputs(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0 and "CartesianProduct" not in plan
    # One-row tables (totals) are all that is joined without a key.
    assert plan.count("BroadcastNestedLoopJoin") <= 2


def test_supported_solutions_are_judged_on_all_data():
    """Three replicates of two; the raw result is another one. The best supported solution is fitted to all data."""
    import numpy as np

    from strandweave.operators import model as M
    from strandweave.plans.thorough import Options, Result, final_rows, judged

    cells = M.Cells(np.array([30.0, 10.0, 20.0]), np.ones(3), np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]]), np.array([10.0, 10, 20]), [1, 2, 3])
    raw = cells.fit([1, 2, 3])
    out = Result(Options(), *[None] * 5, props={1: 0.5, 2: 0.3, 3: 0.2}, loglik=raw.loglik, criterion=raw.criterion("BIC"), members={1: [1], 2: [2], 3: [3]}, raw=(1, 2, 3), raw_props=dict(zip(raw.cids, raw.props, strict=True)))
    reps = [{1: 0.7, 2: 0.3}, {1: 0.6, 2: 0.4}, {1: 0.8, 2: 0.2}, {2: 0.5, 3: 0.5}]
    got = judged(out, cells, raw, reps)
    again = cells.fit([1, 2])
    assert [s.cids for s in got] == [(1, 2), (2, 3)] and got[0].support == 0.75
    assert got[0].props == dict(zip([1, 2], again.props, strict=True)) and got[0].loglik == again.loglik and got[0].criterion == again.criterion("BIC")
    assert np.allclose(got[0].stds, [0.1, 0.1]) and got[1].stds == []
    out.solutions = got
    rows, shares = final_rows(out, {1: 1, 2: 2, 3: 3})
    assert [r[:2] for r in rows] == [("1", 0.75), ("2", 0.25), ("3", 0.0)] and rows[2][2] == f"{raw.loglik:.4f}" and rows[1][4] == "*,*"
    assert ("1", 1, float(again.props[0])) in shares
    out.eligible = False
    assert [s.loglik for s in judged(out, cells, raw, reps)] == [None, None]
