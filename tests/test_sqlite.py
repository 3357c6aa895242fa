"""SQLite files as a data source."""

import datetime
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from trovelight.sources import sqlite


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip_of_a_whole_table(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(5)
    path = f"file://{tmp_path}/orders"
    sqlite.write(orders, path, "orders")
    back = sqlite.read(spark, path, "orders", rows_per_partition=100)
    assert back.schema.simpleString() == orders.schema.simpleString()
    assert rows(back) == rows(orders)
    assert back.rdd.getNumPartitions() >= orders.count() / 100
    sqlite.write(orders.limit(3), path, "orders")
    assert sqlite.read(spark, path, "orders").count() == orders.count() + 3
    sqlite.write(orders.limit(3), path, "orders", "overwrite")
    assert sqlite.read(spark, path, "orders").count() == 3
    assert len([n for n in os.listdir(tmp_path / "orders") if n.endswith(".sqlite")]) == len(sqlite.manifest(str(tmp_path / "orders"))["shards"])


def test_types_nulls_empty_and_clashing_names(spark, tmp_path):
    schema = "`rowid` bigint, `a b` int, `q\"x` string, f double, y boolean, z binary, d date, t timestamp_ntz, e string"
    full = (2**63 - 1, -5, "ä'\"\n", 1.5, True, b"\0\1", datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), "")
    df = spark.createDataFrame([full, full, (None,) * 9, (1, 1, "x" * 200_000, float("inf"), False, b"", None, None, None)], schema)
    sqlite.write(df, str(tmp_path / "a"), "order")
    assert rows(sqlite.read(spark, str(tmp_path / "a"), "order")) == rows(df)
    sqlite.write(df.limit(0), str(tmp_path / "b"), "t")
    empty = sqlite.read(spark, str(tmp_path / "b"), "t")
    assert empty.count() == 0 and empty.columns == df.columns


def test_conditions_mean_the_same_in_the_database(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 4, None if i % 7 == 0 else "äbcÄ"[i % 4] * (i % 3), datetime.date(2024, 1, 1 + i % 28)) for i in range(200)], "k bigint, x double, s string, d date").repartition(3)
    sqlite.write(df, str(tmp_path / "a"), "t")
    k, x, s, d = map(F.col, "kxsd")
    day = datetime.date(2024, 1, 20)
    cases = [
        ([("k", "=", 5)], k == 5), ([("k", "<>", 5)], k != 5), ([("k", ">", 190)], k > 190), ([("k", "in", [1, 2, 300])], k.isin(1, 2, 300)), ([("x", "<=", 3.25)], x <= 3.25), ([("s", "=", "bb")], s == "bb"),
        ([("s", ">", "c")], s > "c"), ([("s", "is null", None)], s.isNull()), ([("s", "is not null", None)], s.isNotNull()), ([("s", "starts with", "ä")], s.startswith("ä")), ([("s", "starts with", "")], s.startswith("")),
        ([("s", "in", ["b", "ÄÄ"])], s.isin("b", "ÄÄ")), ([("d", ">=", day)], d >= day), ([("k", ">", 3), ("s", "=", "b")], (k > 3) & (s == "b")), ([("k", "in", [])], F.lit(False)),
    ]
    for where, same in cases:
        assert rows(sqlite.read(spark, str(tmp_path / "a"), "t", where=where, rows_per_partition=40)) == rows(df.filter(same)), where
    # One DataFrame serves several queries.
    back = sqlite.read(spark, str(tmp_path / "a"), "t", where=[("k", "<", 100)])
    assert (back.filter(k == 5).count(), back.count(), back.filter(k == 1).unionByName(back.filter(k == 2)).count()) == (1, 100, 2)
    for where in ([("x", "<", float("nan"))], [("k", "=", "5")], [("z", "=", 1)], [("k", "like", 1)], [("k", "=", True)]):
        with pytest.raises(Exception, match="can't be compared|no column|no condition"):
            sqlite.read(spark, str(tmp_path / "a"), "t", where=where).collect()


def test_rows_are_left_out_in_the_database(spark, tmp_path):
    raw = sqlite3.connect(tmp_path / "one.db")
    raw.execute("CREATE TABLE t(k INTEGER, n INTEGER)")
    raw.executemany("INSERT INTO t VALUES(?, ?)", [(1, 10), (2, "no number")])
    raw.commit()
    # A row that can't be read isn't met where a condition leaves it out.
    assert rows(sqlite.read(spark, str(tmp_path / "one.db"), "t", where=[("k", "=", 1)])) == [(1, 10)]
    with pytest.raises(Exception, match="column n of t holds a value that is no bigint"):
        sqlite.read(spark, str(tmp_path / "one.db"), "t").collect()


def test_collations_views_and_tables_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "c.db")
    raw = sqlite3.connect(path)
    raw.execute("CREATE TABLE t(s TEXT COLLATE NOCASE, v)")
    raw.executemany("INSERT INTO t VALUES(?, ?)", [("a", 1), ("A", 2)])
    raw.execute("CREATE VIEW w AS SELECT s FROM t WHERE v = 2")
    raw.execute("CREATE TABLE u(k TEXT PRIMARY KEY, oid REAL) WITHOUT ROWID")
    raw.execute("INSERT INTO u VALUES('x', 1)")
    raw.commit()
    assert rows(sqlite.read(spark, path, "t", "s string, v string", [("s", "=", "a")])) == [("a", "1")]
    assert rows(sqlite.read(spark, path, "w")) == [("A",)]
    assert rows(sqlite.read(spark, path, "t", "s string", [("s", "in", ["A", "b"])])) == [("A",)]
    assert rows(sqlite.read(spark, path, "u")) == [("x", 1.0)]
    assert [r[:3] for r in sqlite.tables(path)] == [("t", "table", "s"), ("t", "table", "v"), ("u", "table", "k"), ("u", "table", "oid"), ("w", "view", "s")]


def test_reading_never_writes_and_ends_in_time(spark, tmp_path):
    raw = sqlite3.connect(tmp_path / "r.db")
    raw.execute("CREATE TABLE t(k INTEGER)")
    raw.execute("INSERT INTO t VALUES(1)")
    raw.execute("CREATE VIEW slow AS WITH RECURSIVE c(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM c WHERE i < 1000000000) SELECT count(*) AS k FROM c")
    raw.commit()
    with sqlite.Reading(str(tmp_path / "r.db"), 5_000) as c:
        for sql in ("INSERT INTO t VALUES(2)", "DROP TABLE t", "UPDATE t SET k = 3"):
            with pytest.raises(sqlite.SqliteError, match="readonly|read-only"):
                c.rows(sql)
    assert raw.execute("SELECT k FROM t").fetchall() == [(1,)]
    with pytest.raises(Exception, match="over the time limit"):
        sqlite.read(spark, str(tmp_path / "r.db"), "slow", "k bigint", timeout_ms=300).collect()
    with pytest.raises(Exception, match="no file or folder"):
        sqlite.read(spark, str(tmp_path / "none.db"), "t").collect()
    with pytest.raises(sqlite.SqliteError, match="mounted path"):
        sqlite.local_path("s3a://bucket/x")


def test_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    path = str(tmp_path / "a")
    sqlite.write(spark.range(10).repartition(2), path, "t")
    bad = spark.range(10).repartition(2).select(F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(1.0).alias("id"))
    with pytest.raises(Exception, match="NaN"):
        sqlite.write(bad, path, "t", "overwrite")
    with pytest.raises(Exception, match="holds t"):
        sqlite.write(spark.range(3), path, "other")
    with pytest.raises(Exception, match="no SQLite form of array"):
        sqlite.write(spark.sql("SELECT array(1) AS a"), path, "t")
    assert sqlite.read(spark, path, "t").count() == 10
