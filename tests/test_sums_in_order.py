"""Weighted identities are added in the order of the table's rows, as the SQL does on one thread, however rows are spread."""

import os

import pytest

from strandweave.operators import alignments as AL
from strandweave.plans import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture
def spread(spark, tmp_path):
    """Three shifted copies of the lines in small row groups, read in many pieces; and a connection of one thread."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"""COPY (SELECT l.* REPLACE ((l_orderkey * 7919 + i) % 15013 AS l_orderkey) FROM range(3) r(i), '{SF}/lineitem.parquet' l)
        TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield str(tmp_path), con
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_identity_filter_on_rows_in_many_pieces(spark, spread):
    d, con = spread
    assert {tuple(r) for r in Q.QUERIES["read_identity_filter"](spark, d).collect()} == set(con.execute(Q.ORACLE["read_identity_filter"]).fetchall())


def test_a_mean_does_not_depend_on_the_order_of_rows(spark):
    rows = [("r", i, 1, x) for i, x in enumerate((0.1, 0.2, 0.3))]
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame([*some, ("s", 1, 10, None)], "query_name string, record_id long, p_align_len int, identity double").coalesce(1)
        assert sorted(tuple(r) for r in AL.by_read(df).collect()) == [("r", 3, ((0.1 + 0.2) + 0.3) / 3, 3), ("s", 10, 1.0, 1)]
    none = spark.createDataFrame([("r", 1, None, 0.5)], "query_name string, record_id long, p_align_len int, identity double")
    assert AL.by_read(none).first()["p_identity"] is None


def test_automatic_identity_on_rows_in_many_pieces(spark, spread):
    """The mean of each of these reads is the strictest threshold but for the last bit of its sum."""
    d, con = spread
    con.execute("""CREATE TABLE ties AS SELECT r AS l_orderkey, r AS l_partkey, r % 8 AS l_suppkey, k::INT AS l_linenumber, ([17, 31, 23, 19, 41, 29, 37][1 + (r // 7 * (k % 2) + r) % 7] + k % 2)::DOUBLE AS l_quantity,
        1.0::DOUBLE AS l_extendedprice, [0.05, 0.08][1 + j]::DOUBLE AS l_discount, 0.04::DOUBLE AS l_tax, 'F' AS l_linestatus FROM range(20000) a(r), range(3) b(k), range(2) c(j) ORDER BY hash(r * 6 + k * 2 + j)""")
    con.execute(f"COPY ties TO '{d}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)")
    assert [tuple(r) for r in Q.QUERIES["auto_min_identity"](spark, d).collect()] == con.execute(Q.ORACLE["auto_min_identity"]).fetchall()
