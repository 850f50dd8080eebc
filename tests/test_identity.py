"""Entities kept batch by batch, assignment in order of arrival, lookups with hot and null keys."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import canonical, combine, entities
from factloom.session import scratch


def some_records(seed, n=120):
    draw = random.Random(seed)
    key = lambda name, m: f"{name}{draw.randrange(m)}" if draw.random() < 0.8 else None
    return [(draw.randrange(500), key("u", 50), key("p", 50), "hot" if draw.random() < 0.03 else None) for _ in range(n)]


COLUMNS = "id long, url string, posting string, tag string"


def test_batches_equal_one(spark):
    rows = some_records(5, 60)
    store = entities.Identities(spark, scratch(spark, "identities"), buckets=8)
    for i in range(3):
        store.add(spark.createDataFrame(rows[i * 20 : i * 20 + 20], COLUMNS), "id", ["url", "posting", "tag"])
    # a record that comes again is one record with all its keys, so the whole is resolved over ids too
    whole = entities.resolve(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, " + COLUMNS), "n", ["id", "url", "posting", "tag"]).select("id", "entity")
    names = {}
    for r in whole.collect():
        names.setdefault(r.entity, set()).add(r.id)
    want = {i: min(ids) for ids in names.values() for i in ids}
    assert {r.id: r.entity for r in store.entities().collect()} == want


def test_a_batch_reads_the_buckets_that_it_meets(spark):
    store = entities.Identities(spark, scratch(spark, "identities"), buckets=64)
    store.add(spark.createDataFrame([(i, f"u{i}", None, None) for i in range(500)], COLUMNS), "id", ["url", "posting", "tag"])
    plan = store._keys([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket")
    assert store._keys([3]).select(F.input_file_name()).distinct().count() == 1 < store._keys().select(F.input_file_name()).distinct().count()
    before = {r.id: r.entity for r in store.entities().collect()}
    store.add(spark.createDataFrame([(1000, "u7", "x", None), (1001, "u8", "x", None), (-5, "u8", None, None)], COLUMNS), "id", ["url", "posting", "tag"])
    after = {r.id: r.entity for r in store.entities().collect()}
    assert {k: v for k, v in after.items() if before.get(k) != v} == {7: -5, 8: -5, 1000: -5, 1001: -5, -5: -5}
    assert store._log().where("old is not null").count() == 2  # the labels 7 and 8, and no record or edge beside


def one_by_one(records, links, official):
    """The records taken one after the other."""
    now = [(r[3], r[0], r[1], r[2]) for r in links]  # active_from, record, canonical, (url, company, posting)
    made = []
    for n, (rid, url, company, posting) in enumerate(sorted(records)):
        oldest = lambda ok: min((x for x in now if ok(x)), key=lambda x: x[:2], default=None)
        had = oldest(lambda x: x[1] == rid)
        same_url = oldest(lambda x: url is not None and x[3][0] == url)
        same_job = oldest(lambda x: company is not None and posting is not None and x[3][1:] == (company, posting))
        if had:
            made.append((rid, had[2], "existing_source"))
            continue
        if rid in official:
            got = (official[rid], "official_link")
        elif same_url:
            got = (same_url[2], "application_url")
        elif same_job:
            got = (same_job[2], "posting_id")
        else:
            got = (f"new-{rid}", "new")
        made.append((rid, *got))
        now.append((10_000 + n, rid, got[0], (url, company, posting)))
    return made


@pytest.mark.parametrize("seed", range(2))
def test_assignment_in_order_of_arrival(spark, seed):
    draw = random.Random(seed)
    key = lambda name, m: f"{name}{draw.randrange(m)}" if draw.random() < 0.85 else None
    records = [(i, key("u", 40), draw.choice([1, 2, None]), key("p", 25)) for i in draw.sample(range(500), 120)]
    links = [(i, f"c{draw.randrange(9)}", (key("u", 60), draw.choice([1, 2]), key("p", 60)), draw.randrange(50)) for i in [*range(600, 615), *[r[0] for r in records[:6]]]]
    official = {records[i][0]: f"o{i}" for i in (3, 9, 20)}
    got = canonical.assign_in_order(
        spark.createDataFrame(records, "record_id long, url string, company long, posting string"), spark.createDataFrame([(i, c, *k, a, None) for i, c, k, a in links], "record_id long, canonical_id string, url string, company long, posting string, active_from long, active_to long"),
        spark.createDataFrame(list(official.items()), "record_id long, canonical_id string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(one_by_one(records, links, official))


def test_a_long_chain_and_hot_keys(spark):
    """Every record follows the one before it by URL and posting in turn; and then all share one URL."""
    chain = [(i, f"u{(i + 1) // 2}", 1, f"p{i // 2}") for i in range(64)]
    none = spark.createDataFrame([], "record_id long, canonical_id string, url string, company long, posting string, active_from long, active_to long")
    got = canonical.assign_in_order(spark.createDataFrame(chain, "record_id long, url string, company long, posting string"), none, none.select("record_id", "canonical_id")).collect()
    assert {r.canonical_id for r in got} == {"new-0"} and sum(r.merged_by == "new" for r in got) == 1
    same = spark.range(300).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 > 0, "u").alias("url"), F.lit(None).cast("long").alias("company"), F.lit(None).cast("string").alias("posting"))
    got = canonical.assign_in_order(same, none, none.select("record_id", "canonical_id")).groupBy("canonical_id").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 100 + [200]


def test_lookup_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([("h", i) for i in range(50)] + [(None, i) for i in range(20)] + [("c", 1), ("d", 2)], "k string, n long")
    known = spark.createDataFrame([("h", 1.5), ("c", 2.5), (None, 9.9)], "k string, x double")
    got = combine.looked_up(rows, known, ["k"]).groupBy("k", "x").count().collect()
    assert {(r.k, r.x): r["count"] for r in got} == {("h", 1.5): 50, (None, None): 20, ("c", 2.5): 1, ("d", None): 1}
