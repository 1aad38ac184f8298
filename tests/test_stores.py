"""Keyed tables, SQLite files and JDBC."""

import glob
import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith

from sparkloom.operators import memory
from sparkloom.sources import files, keyed, sqlite


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _files(path):
    return {f for f in glob.glob(f"{path}/files/*/*/*.parquet")}


def test_merge_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = keyed.KeyedTable(spark, path)
    table.create(spark.range(1_000).select("id", F.lit("old").alias("v")), ["id"], buckets=16)
    before = _files(path)
    batch = spark.createDataFrame([("new", 7), ("more", 5_000)], "v string, id long")
    touched = table.merge(batch, lambda old, new: memory.upsert(old, new, ["id"]))
    assert 1 <= len(touched) <= 2
    assert before < _files(path)  # all old files are there, under their names
    got = dict(rows(table.read(), "id", "v"))
    assert len(got) == 1_001 and got[7] == "new" and got[5_000] == "more" and got[8] == "old"
    kept = [f for n, f in table.version(1).folders.items() if n not in touched]
    assert kept == [table.version(2).folders[n] for n in table.version(1).folders if n not in touched]
    assert rows(table.read(1), "v") == [("old",)] * 1_000
    assert table.merge(batch.limit(0), lambda old, new: old) == []
    assert table.vacuum() == 0 and table.versions() == [2]  # the first write is still read in part
    table.merge(table.read(), lambda old, new: old.limit(0))
    assert table.read().count() == 0 and table.vacuum() == 3  # the last write has no rows and isn't read either


def test_a_merge_that_dies_changes_nothing(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"))
    table.create(spark.range(100).select("id", F.lit(1).alias("v")), ["id"], buckets=4)
    batch = spark.range(50, 150).select("id", F.lit(2).alias("v"))
    dying = lambda old, new: memory.upsert(old, new, ["id"]).withColumn("v", F.when(F.col("id") == 120, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.merge(batch, dying)
    assert table.versions() == [1] and table.read().agg(F.sum("v")).first()[0] == 100
    table.merge(batch, lambda old, new: memory.upsert(old, new, ["id"]))
    assert table.read().agg(F.sum("v")).first()[0] == 50 + 200
    assert table.vacuum() >= 1 and table.read().count() == 150


def test_one_of_two_writers_is_refused(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"))
    table.create(spark.range(10).select("id", F.lit(1).alias("v")), ["id"], buckets=2)

    def meanwhile(old, new):
        keyed.KeyedTable(spark, table.path).merge(new, lambda a, b: memory.upsert(a, b, ["id"]))
        return old

    with pytest.raises(keyed.Conflict):
        table.merge(spark.range(1).select("id", F.lit(5).alias("v")), meanwhile)
    assert dict(rows(table.read(), "id", "v"))[0] == 5
    with pytest.raises(keyed.Conflict):
        table.create(table.read(), ["id"])


def _load(spark, path, table="t", **options):
    sqlite.register(spark)
    return spark.read.format("sqlite").options(path=path, table=table, **options).load()


def test_sqlite_reads_in_parts_with_filters(spark, tmp_path):
    path, log = str(tmp_path / "s.db"), str(tmp_path / "log")
    with sqlite3.connect(path) as store:
        store.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL, ok BOOLEAN, raw BLOB, n NUMERIC)")
        store.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(i, f"n{i % 7}" if i % 5 else None, i / 2, i % 2, bytes([i % 256]), i) for i in range(1, 1_001)])
        store.execute("CREATE TABLE none (a TEXT)")
    df = _load(spark, path, numPartitions=4, log=log)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1_000
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("ok", "boolean"), ("raw", "binary"), ("n", "double")]
    assert df.where("ok").count() == 500 and bytes(df.where("id = 300").first()["raw"]) == bytes([44])
    os.remove(log)
    some = _load(spark, path, numPartitions=4, log=log).where("x > 400 and name = 'n3' and id in (803, 810, 990, 997)")
    assert rows(some, "id") == sorted((i,) for i in (803, 810, 990, 997) if i / 2 > 400 and i % 5 and i % 7 == 3)
    asked = open(log).read()
    assert '"x" > ?' in asked and '"name" = ?' in asked and asked.count("SELECT") == 4
    assert _load(spark, path, "none").collect() == []
    assert _load(spark, path).where("name is null and n >= 990").count() == 3


def test_sqlite_conditions():
    assert sqlite.condition(EqualTo(("a",), 3)) == ('"a" = ?', [3])
    assert sqlite.condition(StringStartsWith(('q"',), "x%")) == ('substr("q""", 1, ?) = ?', [2, "x%"])
    assert sqlite.condition(In(("a",), ("x", None))) == ('"a" IN (?)', ["x"])
    assert sqlite.condition(StringContains(("a",), "x")) is None and sqlite.condition(EqualTo(("a", "b"), 1)) is None


def test_sqlite_writes_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "w.db")
    sqlite.register(spark)
    write = lambda df, mode="append": df.write.format("sqlite").mode(mode).options(path=path, table="t").save()
    df = spark.range(0, 500, 1, 5).select("id", F.format_string("v%d", "id").alias("v"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") > 3, F.lit(1.5)).alias("x"))
    write(df)
    write(df.withColumn("id", F.col("id") + 500))
    assert _load(spark, path).count() == 1_000 and _load(spark, path).where("x is null").count() == 8
    with pytest.raises(Exception, match="lost"):
        write(df.coalesce(1).withColumn("v", F.when(F.col("id") == 499, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), "overwrite")
    assert _load(spark, path).count() == 1_000
    write(df.limit(10), "overwrite")
    assert _load(spark, path).count() == 10 and not glob.glob(f"{path}.parts*")
    with pytest.raises(ValueError):
        sqlite.SqliteWriter({"path": path, "table": "t"}, spark.sql("select array(1) a").schema, False)


def test_jdbc(spark):
    url = "jdbc:derby:memory:sparkloom;create=true"
    spark.range(100).select("id", F.format_string("v%d", "id").alias("v")).write.jdbc(url, "things", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    df = files.jdbc(spark, url, "things", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    assert df.rdd.getNumPartitions() == 4 and df.where("id >= 90").count() == 10
