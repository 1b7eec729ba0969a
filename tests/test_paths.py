"""Path, sequence and statistics functions on small cases, and their laws on generated ones."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import paths as P
from strandweave.functions import sequences as S
from strandweave.functions import stats as T
from strandweave.operators import search as SE


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


PATH = "array<struct<n:string,e:boolean>>"


def test_parse_and_write(spark):
    assert one(spark, P.parse_gaf(F.col("s")), s=(">53<45:1-20>33", "string")) == [("53", True), ("45", False), ("33", True)]
    assert one(spark, P.parse_gaf(F.col("s")), s=("53", "string")) == [("53", True)]
    assert one(spark, P.parse_bandage(F.col("s")), s=("53+,45-,33(circular)", "string")) == [("53", True), ("45", False), ("33", True)]
    assert one(spark, P.to_gaf(F.col("p")), p=([("a", True), ("b", False)], PATH)) == ">a<b"
    assert one(spark, P.to_bandage(F.col("p"), F.lit(True)), p=([("a", True), ("b", False)], PATH)) == "a+,b-(circular)"


def test_roll(spark):
    p = lambda s: [(c, True) for c in s]
    for given_, want in (("12121", "12"), ("23412", "2341"), ("1", "1"), ("1212", "12"), ("123", "123")):
        assert [x[0] for x in one(spark, P.roll(F.col("p")), p=(p(given_), PATH))] == list(want)


def test_canonical_laws(spark):
    rng = random.Random(3)
    rows = [([(rng.choice("abc"), rng.random() < 0.5) for _ in range(rng.randint(1, 6))],) for _ in range(60)]
    df = spark.createDataFrame(rows, f"p {PATH}")
    got = df.select(
        (P.canonical(F.col("p")) == P.canonical(P.reverse_path(F.col("p")))).alias("a"),
        (P.canonical_circular(F.col("p")) == P.canonical_circular(F.concat(F.slice("p", F.lit(2), F.size("p")), F.slice("p", F.lit(1), F.lit(1))))).alias("b"),
        P.canonical_circular(F.col("p")).alias("c"),
        "p",
    ).collect()
    for r in got:
        assert r["a"] and r["b"]
        assert [tuple(x) for x in r["c"]] == SE.canonical_ring([tuple(x) for x in r["p"]])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(1, 4))
def test_unit_of_repeats(u, k):
    path = [(c, True) for c in u] * k
    unit = SE.unit(path)
    assert len(unit) <= len(u) and all(path[i] == unit[i % len(unit)] for i in range(len(path)))


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s=("ATGCRn", "string")) == "nYGCAT"
    assert [tuple(x) for x in one(spark, S.cigar_ops(F.col("s")), s=("8=1X12D", "string"))] == [(8, "="), (1, "X"), (12, "D")]
    orf = "CC" + "ATG" + "GCA" * 80 + "TAA" + "GC"
    assert one(spark, S.orf_lengths(F.col("s")), s=(orf, "string")) == [243]
    assert one(spark, S.bases_of(F.col("s")), s=("r", "string")) == "AG"


def test_start_count(spark):
    # contigs a=2 b=3 c=4 d=5 e=6 without overlaps, path b-e-d, a read of 11 bases: three starts
    lit = lambda v: F.lit(v)
    assert one(spark, T.start_count(lit(11), lit(3), lit(14), lit(6), lit(3), lit(5)), s=(1, "int")) == 3
    assert one(spark, T.start_count(lit(11), lit(1), lit(14), lit(0), lit(None), lit(None)), s=(1, "int")) == 4


def test_gcd_and_breaks(spark):
    assert one(spark, T.gcd_of(F.col("v")), v=([12, 18, 30], "array<long>")) == 6
    assert tuple(one(spark, T.index_in_breaks(F.col("v"), F.lit(21)), v=([1, 5, 10, 15, 20], "array<int>"))) == (4, 1)
