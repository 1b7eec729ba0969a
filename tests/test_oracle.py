"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "~" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(entry.oracle_sql()[name])
    assert got == canon([c[0] for c in rel.description], rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    if name == "pipeline" or name.startswith("op"):
        pytest.skip("tested in its own folder")
    assert entry.queries()[name](spark, SF).count() > 0


def test_walks_are_walks(spark):
    """Every step of a walk is a link of the graph."""
    from strandweave.functions import paths as P
    from strandweave.plans import adapters as A
    from pyspark.sql import functions as F

    links = {(r["v1"], r["e1"], r["v2"], r["e2"]) for r in A.contig_links(spark, SF).collect()}
    reads = {tuple(x) for r in A.reads(spark, SF).select(F.explode(P.links(F.col("path"))).alias("l")).select("l.*").collect() for x in [r]}
    for r in entry.queries()["walks"](spark, SF).select(P.links(P.parse_gaf(F.col("path"))).alias("l")).collect():
        for x in r["l"]:
            back = (x["v2"], x["e2"], x["v1"], x["e1"])
            assert tuple(x) in links or tuple(x) in reads or back in reads
