"""Seeds, imports, audits, collections of several pages and views against plain loops and odd rows."""

import datetime as dt
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.operators import combine, expansion, tables
from factloom.sources import connectors

ARTIFACT = f"{expansion.ARTIFACT}, place int"
KEYS = ("company_name", "referrer_url", "referrer_basis")


def artifact(seed, n=40):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    return [(pick("lever", "ashby", None), pick("A", "a", "b", "B", "c", None), pick(None, "x", "y"), f"https://s/{seed}/{i}", pick(None, {}, {"k": str(i)}, {"l": str(i), "k": "0"}), pick(None, True, False), pick(None, "u", "v"), pick(None, "p"), i) for i in range(n)]


def one_by_one(store, rows):
    """A store after an artifact, taken row by row, and how many rows were inserted and updated."""
    inserted = updated = 0
    for kind, tenant, *values, _ in rows:
        if kind is None or tenant is None:
            continue
        new = dict(zip(("company_name", "source_url", "locator", "japan_signal", "referrer_url", "referrer_basis"), values, strict=True)) | {"tenant": tenant}
        new |= {"japan_signal": bool(new["japan_signal"]), "locator": dict(new["locator"] or {})}
        old = store.get((kind, tenant.lower()))
        inserted, updated = inserted + (old is None), updated + (old is not None)
        if old:
            new |= {k: old[k] if old[k] is not None else new[k] for k in KEYS} | {"tenant": old["tenant"], "japan_signal": old["japan_signal"] or new["japan_signal"], "locator": old["locator"] | new["locator"]}
        store[kind, tenant.lower()] = new
    return inserted, updated


def test_imports_as_one_by_one(spark, tmp_path):
    store, plain = tables.BucketTable(spark, f"file://{tmp_path}/t", ["kind", "tenant_key"], buckets=2), {}
    for seed, apply in ((1, False), (1, True), (2, False), (2, True)):
        rows = artifact(seed)
        report = expansion.import_tenants(store, spark.createDataFrame(rows, ARTIFACT), apply).collect()
        own = [r for r in rows if r[0] and r[1]]
        known = sum((r[0], r[1].lower()) in plain for r in own)
        counts = one_by_one(plain, rows) if apply else (0, 0)
        total = lambda c, rs=report: sum(r[c] for r in rs)
        assert (total("candidates"), total("would_insert"), total("would_update"), total("inserted"), total("updated")) == (len(own), len(own) - known, known, *counts)
        assert total("japan_signals") == sum(bool(r[5]) for r in own) and total("most_requests") == 120 * len(own)
    got = {(r.kind, r.tenant_key): {k: v for k, v in r.asDict().items() if k not in ("kind", "tenant_key")} for r in store.rows().collect()}
    assert {k: v | {"locator": v["locator"] or {}} for k, v in got.items()} == plain


def test_empty_import(spark, tmp_path):
    store = tables.BucketTable(spark, f"file://{tmp_path}/t", ["kind", "tenant_key"], buckets=2)
    assert expansion.import_tenants(store, spark.createDataFrame([], ARTIFACT), True).count() == 0 and store.rows().count() == 0


def test_merged_seeds(spark):
    rows = [("lever", "Acme", None, "r0", 0), ("lever", "acme", "Acme Inc", "r1", 1), ("lever", "ACME", "Other", None, 2), ("lever", "a/b", "bad", None, 3), ("workday", "x", "bad", None, 4), ("workday", "x.wd3.myworkdayjobs.com/j", None, None, 5), (None, None, None, None, 6), ("ashby", "b", None, None, 7), ("ashby", "B2", "Bee", None, 8)]
    got = expansion.merged_seeds(spark.createDataFrame(rows, "kind string, tenant string, company_name string, referrer_url string, place int")).orderBy("rank").collect()
    assert [(r.rank, r.kind, r.tenant, r.company_name, r.referrer_url) for r in got] == [(1, "ashby", "B2", "Bee", None), (2, "lever", "ACME", "Acme Inc", "r0"), (3, "ashby", "b", None, None), (4, "workday", "x.wd3.myworkdayjobs.com/j", None, None)]


def test_audits(spark):
    good = [f"https://c.example/career/{i}" for i in range(9)]
    rows = [("a", [*good, good[0], None]), ("a", ["https://c.example/jobs/1"]), ("b", ["https://c.example/news"]), ("c", None), ("d", [])]
    queue = expansion.audit_queue(spark.createDataFrame(rows, "company string, links array<string>"), "company", "links").orderBy("company", F.desc("score"), "url").collect()
    assert [(r.company, r.url) for r in queue] == [("a", "https://c.example/jobs/1"), *[("a", u) for u in good[:5]]]
    audited = spark.createDataFrame([("a", [("lever",), ("lever",)]), ("b", [("lever",), ("ashby",)]), ("c", []), ("d", None)], "company string, sources array<struct<kind: string>>")
    assert sorted(tuple(r) for r in expansion.audit_report(audited, "company", "sources").collect()) == [("ashby", 1, 4, 2), ("lever", 3, 4, 2)]


def test_robots_gate(spark):
    pages = spark.createDataFrame([("User-agent: *\nDisallow: /x", "/a"), (None, "/b")], "robots string, path string")
    assert expansion.robots_gate(pages, "robots", "path").count() == 2
    for bad in ("/x/1", None):
        with pytest.raises((PySparkException, Py4JJavaError)):
            expansion.robots_gate(spark.createDataFrame([("User-agent: *\nDisallow: /x", bad)], "robots string, path string"), "robots", "path").collect()


def test_window_report(spark):
    day = dt.date(2026, 7, 1)
    leads = spark.createDataFrame([("t", day, False), ("t", day - dt.timedelta(30), None), ("t", day - dt.timedelta(31), False), ("t", day + dt.timedelta(1), False), ("t", None, False), ("t", day, True), (None, day, False)], "tenant string, day date, known boolean")
    now = F.lit("2026-07-01 03:00:00").cast("timestamp")
    report = lambda days: {r.tenant: tuple(r)[1:] for r in expansion.window_report(leads, "tenant", F.col("day"), F.col("known"), days, now).collect()}
    assert report(30) == {"t": (6, 3, 2, 2, 1), None: (1, 1, 1, 0, 0)}
    assert report(None)["t"] == (6, 6, 5, 0, 0)


def test_views(spark):
    rows = [(1, True, True, None, True), (2, True, True, "d", False), (3, False, None, None, None), (4, True, None, None, None), (5, None, False, "d", None)]
    df = spark.createDataFrame(rows, "id int, eligible boolean, saved boolean, applied string, hidden boolean")
    shown = lambda view: [r.id for r in df.where(expansion.in_view(F.lit(view), F.col("eligible"), F.col("saved"), F.col("applied"), F.col("hidden"))).orderBy("id").collect()]
    assert [shown(v) for v in ("saved", "applied", "hidden", "recommendations", "anything")] == [[2], [2, 5], [1], [2, 4], [2, 4]]


def test_ranked_histogram(spark):
    df = spark.createDataFrame([(x,) for x in ["漢", "い", "ア", None, "b", "B", "a", "い"]], "x string")
    got = combine.ranked_histogram(df, F.col("x")).orderBy("rank").collect()
    assert [(r.key, r.n) for r in got][:3] == [("い", 2), ("a", 1), ("b", 1)] and [r.key for r in got][3:] == ["B", "ア", "漢", None]


def record(kind, body, page=1, tenant="acme"):
    return {"source_id": "s", "kind": kind, "tenant": tenant, "run_id": "r", "page_no": page, "cursor": None, "body": body}


def test_categories_and_whole_collections(spark):
    first = '<a href="/acme/job_offers/1">One</a><a href="/acme/list?c=1&amp;p=2">c</a><a href="/acme/list?c=1&amp;p=2">c</a><a href="/other/list?c=9">x</a><a href="https://evil.example/acme/list?c=3">x</a>'
    assert list(connectors.category_urls(record("jobcan", first))) == [("s", "r", "https://recruit.jobcan.jp/acme/list?c=1&p=2")]
    assert not list(connectors.category_urls(record("herp", first))) and not list(connectors.category_urls(record("jobcan", None)))
    second = '<a href="/acme/job_offers/1">One, later</a><a href="/acme/job_offers/2">Two</a>'
    rows = [r for i, body in enumerate((first, second, "")) for r in connectors.page_rows(record("jobcan", body, i + 1))]
    whole = connectors.whole_collections(spark.createDataFrame(rows, connectors.ROW)).orderBy("external_id").collect()
    assert [(r.external_id, r.title, r.page_no, r.provider_total) for r in whole] == [("1", "One, later", 2, 2), ("2", "Two", 2, 2)]


def test_pages_named_in_escaped_json():
    body = f"<div data-x='{json.dumps({'u': 'https://open.talentio.com/r/1/c/acme/pages/7'}).replace(chr(34), '&quot;')}'></div><a href='/r/1/c/acme/pages/8'>Eight</a><i>https://open.talentio.com/r/1/c/other/pages/9</i>"
    rows = list(connectors.page_rows(record("talentio", body)))
    assert sorted((r[8], r[9]) for r in rows) == [(n, f"https://open.talentio.com/r/1/c/acme/pages/{n}") for n in "78"]


def test_sitemap_records(spark):
    bodies = spark.createDataFrame([("<loc> https://open.talentio.com/r/1/c/a/pages/1/ </loc><loc>https://open.talentio.com/r/1/c/a/pages/1</loc><loc>https://x.example/r/1/c/a/pages/2</loc><loc>not a url</loc>",), (None,), ("",)], "body string")
    assert [tuple(r) for r in connectors.sitemap_records(bodies, "body").collect()] == [("a", "1", "https://open.talentio.com/r/1/c/a/pages/1")]
    assert connectors.sitemap_records(bodies, "body", spark.createDataFrame([("b",)], "tenant string")).count() == 0
