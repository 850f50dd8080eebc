"""Work that grows with the input: no step holds more rows than the job needs, and no row is shuffled more often than it must."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import jobs, text
from factloom.operators import extraction, parsing, promotion, tables
from factloom.plans import catalog
from factloom.sources import html
from tests.helpers import same_as_sql


def nodes(df):
    """The executed plan's nodes, after df was collected."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        yield p
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(p.executedPlan() if name == "AdaptiveSparkPlanExec" else p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]


def most_rows(df) -> int:
    """The most rows that any step of a collected df put out."""
    found = [p.metrics().get("numOutputRows") for p in nodes(df)]
    return max(m.get().value() for m in found if m.isDefined())


def _sides(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "attempts": t([(1, "leased", "w", 7)], "attempt_id long, state string, lease_owner string, candidate_id long"),
        "candidates": t([(7, "resolved", "recent", 3)], "candidate_id long, state string, publication_freshness string, resolved_source long"),
        "records": t([(5, 3, "active"), (6, 4, "active")], "record_id long, source_id long, lifecycle_state string"),
        "sources": t([(3, "verified")], "source_id long, verification_state string"),
        "relations": t([(30, 3, "verified", None)], "relation_id long, source_id long, verification_state string, valid_to string"),
        "evidence": t([(300, 30)], "evidence_id long, relation_id long"),
        "links": t([(5, 9, None), (6, 9, None)], "record_id long, canonical_id long, active_to string"),
        "canonical": t([(9, "active")], "canonical_id long, lifecycle_state string"),
    }


def test_promotion_claims_are_not_multiplied(spark):
    """A claim made twice is told twice, not four times; a record of another source, a null and a worker without the lease have no candidate."""
    claims = spark.createDataFrame([(1, "w", 5, 9), (1, "w", 5, 9), (1, "w", 6, 9), (1, "v", 5, 9), (None, "w", 5, 9), (1, "w", 5, None)], "attempt_id long, worker string, record_id long, canonical_id long")
    got = promotion.complete(claims, **_sides(spark)).collect()
    assert sorted((r.attempt_id or 0, r.worker, r.record_id, r.canonical_id or 0, r.candidate_id or 0) for r in got) == [(0, "w", 5, 9, 0), (1, "v", 5, 9, 0), (1, "w", 5, 0, 0), (1, "w", 5, 9, 7), (1, "w", 5, 9, 7), (1, "w", 6, 9, 0)]


def test_candidates_of_one_url_are_not_paired(spark):
    """300 candidates of one URL: each has the oldest other one as survivor, and no step has a row for each pair."""
    k = F.col("id")
    candidates = spark.range(300).select(k.alias("candidate_id"), F.lit("resolving").alias("state"), F.lit("recent").alias("publication_freshness"), F.when(k % 3 > 0, "u").alias("official_url"), (1000 - k).alias("created_at"))
    asked = spark.range(300).select(k.alias("candidate_id"), F.lit("resolved").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("u").alias("official_url"), F.lit(3).alias("source_id"), F.array(F.lit(300)).alias("evidence_ids"))
    sides = _sides(spark)
    df = promotion.resolve_candidates(candidates, asked, sides["sources"], sides["relations"], sides["evidence"])
    reasons = {r.candidate_id: r.reason for r in df.collect()}
    assert reasons.pop(299) == "strong_duplicate_of:298" and set(reasons.values()) == {"strong_duplicate_of:299"}
    assert most_rows(df) <= 300


def test_json_documents_are_walked_once(monkeypatch):
    """The values of all keys come from one walk, in the order and to the depth of a search for each key."""
    deep = {"k": 1}
    for _ in range(12):
        deep = {"k": [deep, {"description": "d"}], "skills": ["Go"]}
    found = html.values_by_key(deep)
    assert all(found.get(key, []) == list(html.find_key(deep, key)) for key in ("k", "description", "skills", "none")) and len(found["k"]) == 5

    def searched(*_):
        raise AssertionError("one search for each key")

    monkeypatch.setattr(html, "find_key", searched)
    text = "Python を使う仕事です。長い説明がここに続きます。"
    assert {s["kind"] for s in html.document(json.dumps({"title": "Engineer", "description": text}), "lever").sections} == {"title", "responsibilities"}


def test_json_sections_use_all_cores(spark, data):
    assert catalog.QUERIES["json_sections"](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_values_with_evidence_parses_versions_once(spark, data, duck):
    df = catalog.QUERIES["values_with_evidence"](spark, data)
    same_as_sql(df, duck, catalog.ORACLES["values_with_evidence"])
    assert sum(p.nodeName() == "MapInArrow" for p in nodes(df.select("*"))) == 1


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = tables.BucketTable(spark, f"file://{tmp_path}/t", ["id"], buckets=1)
    store.append(spark.range(1000))
    assert len(list(tmp_path.glob("t/data/*/*/*.parquet"))) > 1 and store.rows().count() == 1000


def test_documents_of_all_orders_are_stored(spark, data):
    got = {r.o_orderkey for r in catalog.QUERIES["documents_stored"](spark, data).collect()}
    assert got == {r.o_orderkey for r in spark.read.parquet(f"{data}/orders.parquet").where("o_orderkey % 50 <> 0").collect()}


def test_rows_are_staged_only_while_they_are_added(spark, tmp_path):
    """What an append reads twice is gone afterwards, also if it drifts; only the store's own files stay."""
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    files = lambda: set(shared.rglob("part-*"))
    store, rows, before = tables.BucketTable(spark, f"file://{tmp_path}/t", ["id"], buckets=2), spark.range(100).withColumn("hash", F.lit("a")), files()
    assert tables.append_once(store, rows, "hash") == 100 and tables.append_once(store, rows, "hash") == 0
    with pytest.raises(ValueError, match="drift"):
        tables.append_once(store, rows.withColumn("hash", F.lit("b")), "hash")
    assert files() == before and store.rows().count() == 100


def test_an_extraction_is_stored_as_one_row(spark, tmp_path):
    """Its children are made where they are read; what a call reads twice is gone afterwards, and a replay writes no file."""
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    made = spark.createDataFrame([(i, i % 3, "lever", "u", '{"title": "Engineer", "salary": "年収 5000000円", "description": "Python and AWS at work"}') for i in range(20)], "version int, record int, source_kind string, source_url string, raw string").withColumn("fetched", F.current_timestamp())
    store, files = extraction.Extractions(spark, f"file://{tmp_path}/s", buckets=2), lambda: {f for f in shared.rglob("part-*") if "extractions-" in str(f)}
    before = files()
    store.add(parsing.parse_versions(made), "version", "record", "fetched")
    written = set(tmp_path.glob("s/rows/data/*/*/*.parquet"))
    store.add(parsing.parse_versions(made), "version", "record", "fetched")
    assert store.stored.rows().count() == 20 and store.rows().count() > 20 * 20 and files() == before
    assert set(tmp_path.glob("s/rows/data/*/*/*.parquet")) == written
    bare = parsing.parse_versions(made.withColumn("version", F.col("version") + 100)).withColumn("evidence", F.filter("evidence", lambda e: e["field"] != "skills"))
    with pytest.raises(PySparkException, match="a value of skills has no evidence"):
        store.add(bare, "version", "record", "fetched")
    assert store.stored.rows().count() == 20


def test_values_meet_their_evidence_without_a_shuffle(spark, data):
    df = catalog.QUERIES["values_with_evidence"](spark, data)
    df.collect()
    assert max(p.metrics().get("shuffleRecordsWritten").get().value() for p in nodes(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec" and p.metrics().get("shuffleRecordsWritten").isDefined()) <= 1500


def test_patterns_are_tried_where_their_words_stand(spark):
    """No text that a pattern matches lacks its plain words, in any case that the pattern accepts."""
    assert [text.literals(p) for p in (r"\bNode\.?js\b", r"Excel.{0,12}(?:VBA|マクロ)|\bVBA\b", r"\d+|x", "colou?r", "a{2}bc|[def]g")] == [("node",), ("excel", "vba"), (), ("colo",), ("bc", "g")]
    said = ["JAVA and javascript", "next.JS nodejs", "\u212aubernetes", "typeſcript", "Excel の マクロ", "人工知能", "MS  word", "golang", "none", "", None, "ai\u0130OS"]
    df = spark.createDataFrame([(x,) for x in said], "t string").coalesce(1)
    for row in df.select("t", jobs.skills(F.col("t"), F.lit("r"))["skill"].alias("got"), *[F.col("t").rlike(text.js(p)).alias(s) for s, p in jobs.SKILLS]).collect():
        assert (row.got or []) == [s for s, _ in jobs.SKILLS if row[s]]


def test_short_phrases_are_read_once():
    """Results of short texts are kept, of long ones not, and never more than so many."""
    asked = []
    f = html.remembered(lambda t: asked.append(t) or t.upper())
    long = "x" * (html.SHORT + 1)
    assert [f(t) for t in ("a", "b", "a", long, long)] == ["A", "B", "A", long.upper(), long.upper()] and asked == ["a", "b", long, long]
    assert all(f(str(i)) == str(i) for i in range(2 * html.REMEMBERED)) and len(f.__closure__[1].cell_contents) <= html.REMEMBERED
    assert (html.section_kind("スキル", "x"), html.section_kind("", "スキル"), html.section_kind("1 スキル", "")) == ("skills", "other", "skills")
