"""Tables by bucket, append-once stores, a streaming source of recorded pages and a committing sink of objects."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import tables
from factloom.session import scratch
from factloom.sources import connectors, html, objects


def size_written(root):
    return {p for p in root.rglob("*.parquet")}


def test_a_change_writes_the_buckets_that_it_meets(spark, tmp_path):
    store = tables.BucketTable(spark, f"file://{tmp_path}", ["k"], buckets=64)
    store.change(spark.range(2000).select(F.col("id").alias("k"), F.lit(0).alias("v")), lambda old, new: new)
    first = size_written(tmp_path)
    store.change(spark.createDataFrame([(5, 1), (9000, 1)], "k long, v int"), lambda old, new: tables.upsert(old, new, ["k"]).drop("action"))
    second = size_written(tmp_path) - first
    assert len(first) == 64 and len(second) <= 2
    assert {r.k: r.v for r in store.rows().where("v = 1").collect()} == {5: 1, 9000: 1} and store.rows().count() == 2001
    assert len(store.lookup(spark.createDataFrame([(5,)], "k long")).inputFiles()) <= 2


def test_appends_are_put_together(spark, tmp_path):
    store = tables.BucketTable(spark, f"file://{tmp_path}", ["k"], buckets=2, folders=3)
    for i in range(6):
        store.append(spark.createDataFrame([(i, "x"), (i + 100, "y")], "k int, v string"))
    assert sorted(r.k for r in store.rows().collect()) == [0, 1, 2, 3, 4, 5, 100, 101, 102, 103, 104, 105]
    assert max(len(f) for f in store.head()["buckets"].values()) <= 4


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    store = tables.BucketTable(spark, f"file://{tmp_path}", ["k"], buckets=4)
    store.append(spark.createDataFrame([(1, 1)], "k int, v int"))
    with pytest.raises(Exception, match="planted"):
        store.change(spark.createDataFrame([(1, 2)], "k int, v int"), lambda old, new: new.withColumn("v", F.raise_error(F.lit("planted")).cast("int")))
    assert [tuple(r) for r in store.rows().collect()] == [(1, 1)]


def test_documents_are_stored_once_and_drift_fails(spark):
    rows = [(1, "lever", json.dumps({"title": "An engineer at work", "description": "Full-time work in Tokyo"})), (2, "lever", json.dumps({"title": "A second engineer", "description": "Part-time work in Osaka"}))]
    found = html.documents(spark.createDataFrame(rows, "version_id int, kind string, raw string"), "raw", "kind")
    store = tables.BucketTable(spark, scratch(spark, "documents"), ["version_id"], buckets=8)
    assert [tables.append_once(store, found, "content_hash") for _ in range(2)] == [2, 0]
    changed = html.documents(spark.createDataFrame([(3, *rows[0][1:]), (2, "lever", rows[1][2].replace("Osaka", "Kyoto"))], "version_id int, kind string, raw string"), "raw", "kind")
    with pytest.raises(ValueError, match=r"drift: \(2,\)"):
        tables.append_once(store, changed, "content_hash")
    assert sorted(r.version_id for r in store.rows().collect()) == [1, 2]


def test_raw_objects_write_little(spark, tmp_path):
    store = objects.RawObjects(spark, f"file://{tmp_path}", buckets=32)
    assert store.put_if_absent(spark.range(300).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("bytes"))) == 300
    before = size_written(tmp_path)
    assert store.put_if_absent(spark.createDataFrame([(b"new",), (b"7",)], "bytes binary")) == 1
    assert len(size_written(tmp_path) - before) == 1 and store.get(hashlib.sha256(b"new").hexdigest()) == b"new"
    assert all(r["key"] == objects.key_of(r.hash) for r in store.table().limit(5).collect())


def page(n):
    return json.dumps({"source_id": "s", "kind": "lever", "tenant": f"t{n}", "run_id": "r", "page_no": 1, "cursor": None, "body": json.dumps([{"id": f"{n}-{i}", "text": "t"} for i in range(3)])})


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(connectors.RecordedPages)
    spark.dataSource.register(connectors.ContentObjects)
    folder, store = tmp_path / "in", tmp_path / "store"
    folder.mkdir()

    def run():
        rows = spark.readStream.format("recorded_pages").option("path", str(folder)).option("settle", "0").load().select(F.encode(F.concat_ws("|", "stable_key", "title"), "UTF-8").alias("bytes"))
        query = rows.writeStream.format("content_objects").option("path", str(store)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        return {bytes(r.bytes).decode().split("|")[0] for r in connectors.content_objects(spark, str(store)).collect()}

    for n in (4, 3):
        (folder / f"{n}.jsonl").write_text(page(n) + "\n")
    assert run() == {f"lever:t{n}:{n}-{i}" for n in (3, 4) for i in range(3)}
    time.sleep(0.05)
    (folder / "0.jsonl").write_text(page(0) + "\n")  # a later file with an earlier name
    assert run() == {f"lever:t{n}:{n}-{i}" for n in (0, 3, 4) for i in range(3)}
    assert sum(len(json.loads(p.read_text())) for p in (store / "commits").glob("*.json")) == len(list((store / "objects").glob("*.parquet")))
    files = spark.read.parquet(str(store / "objects"))
    assert files.count() == 9  # no page was read twice


def test_a_failed_write_leaves_no_object(spark, tmp_path):
    spark.dataSource.register(connectors.ContentObjects)
    rows = spark.range(40).repartition(4).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("bytes"))
    bad = rows.withColumn("bytes", F.when(F.col("bytes") == F.encode(F.lit("7"), "UTF-8"), F.raise_error(F.lit("planted")).cast("binary")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="planted"):
        bad.write.format("content_objects").option("path", str(tmp_path)).mode("append").save()
    assert connectors.content_objects(spark, str(tmp_path)).count() == 0
    time.sleep(1)  # tasks that were still at work
    connectors.sweep_objects(str(tmp_path), 0)
    assert not list(tmp_path.rglob("*.parquet")) and not list(tmp_path.rglob("*.json"))
    for _ in range(2):
        rows.write.format("content_objects").option("path", str(tmp_path)).mode("append").save()
    assert connectors.content_objects(spark, str(tmp_path)).count() == 40 and connectors.sweep_objects(str(tmp_path), 0) == 0
