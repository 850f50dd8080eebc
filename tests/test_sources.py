"""Connectors on recorded answers, documents, crawling, objects."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import connectors, crawl, html, objects

POSTING = {"@type": "JobPosting", "title": "Engineer", "url": "https://x.example/jobs/7", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressRegion": "東京都", "addressLocality": "港区"}}, "datePosted": "2026-07-01", "description": "<p>Build</p><ul><li>things</li></ul>", "employmentType": "FULL_TIME"}


def rec(kind, body, page=1, cursor=None, tenant="acme"):
    return {"source_id": "s", "kind": kind, "tenant": tenant, "run_id": "r", "page_no": page, "cursor": cursor, "body": body if isinstance(body, str) else json.dumps(body)}


@pytest.mark.parametrize(
    ("record", "ids", "last", "cursor", "total"),
    [
        (rec("greenhouse", {"jobs": [{"id": 1, "title": "A", "absolute_url": "u", "location": {"name": "Tokyo"}}], "meta": {"total": 1}}), ["1"], True, None, 1),
        (rec("smartrecruiters", {"content": [{"id": "a"}], "totalFound": 2}), ["a"], False, "1", 2), (rec("lever", [{"id": "l", "text": "t", "createdAt": 1782864000000}]), ["l"], True, None, None),
        (rec("ashby", {"jobs": [{"id": "x"}, {"id": "y", "isListed": False}, {"id": "x"}]}), ["x"], True, None, 1),
        (rec("workday", {"total": 0, "jobPostings": [{"title": "W", "externalPath": "/job/Tokyo/w_1"}]}, 2, "20:21"), ["w_1"], True, None, 21), (rec("workday", {"total": 25, "jobPostings": [{"externalPath": f"/job/{i}"} for i in range(20)]}), [str(i) for i in range(20)], False, "20:25", 25),
        (rec("hrmos", '<i id="jsi-total-count" value="3"></i><a href="/pages/acme/jobs/1">One</a><a href="/pages/other/jobs/2">x</a><div class="pg-pagenation"><a>3</a><a>2</a></div>'), ["1"], False, "2", 3),
        (rec("jobcan", '<a href="/acme/job_offers/44">J</a><a href="/acme/about">x</a>'), ["44"], True, None, None),
        (rec("schema_org", f'<script type="application/ld+json">{json.dumps({"@graph": [POSTING]})}</script>'), ["https://x.example/jobs/7"], True, None, 1),
    ],
)
def test_pages(record, ids, last, cursor, total):
    rows = list(connectors.page_rows(record))
    assert ([r[8] for r in rows], rows[0][3], rows[0][4], rows[0][5]) == (ids, last, cursor, total) and all(r[-1] is None for r in rows)


def test_page_errors_are_rows():
    for body in ("not json", {"jobs": []}, {"total": 5, "jobPostings": []}):
        row, = connectors.page_rows(rec("workday", body))
        assert row[-1].startswith("schema_changed") and row[3] is False


def test_data_source(spark, tmp_path):
    lines = [rec("lever", [{"id": f"{n}-{i}", "text": "t"} for i in range(3)], tenant=f"t{n}") for n in range(4)]
    for n, line in enumerate(lines):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps(line) + "\n")
    df = connectors.recorded_pages(spark, str(tmp_path))
    assert df.count() == 12 and df.select("stable_key").distinct().count() == 12


def test_documents():
    page = f'<html><body><script type="application/ld+json">{json.dumps(POSTING)}</script></body></html>'
    kinds = {s["kind"]: s["text"] for s in html.document(page, "schema_org").sections}
    assert kinds["title"] == "Engineer" and kinds["employment"] == "FULL_TIME" and "things" in kinds["responsibilities"]
    plain = "<body><nav>menu</nav><h1>Job</h1><section><h2>勤務地</h2><p>東京都港区<br>駅近く</section><dl><dt>給与</dt><dd>月給22万円</dd></dl></body>"
    kinds = {s["kind"]: s for s in html.document(plain, "hrmos").sections}
    assert "東京都港区" in kinds["location"]["text"] and kinds["compensation"]["text"] == "月給22万円" and "menu" not in str(kinds)
    with pytest.raises(ValueError):
        html.document("<body></body>", "x")
    props = html.html_text.__module__ and json.dumps({"recruitmentOpenPage": {"name": "Page", "requisitionDetails": [{"name": "雇用形態", "value": "正社員として働きます、長期で"}]}})
    assert any(s["kind"] == "employment" for s in html.document(f"<div data-react-props='{props}'></div>", "talentio").sections)


def test_text_and_chunks():
    assert html.html_text("&lt;p&gt;a&lt;/p&gt;&lt;p&gt;b&lt;/p&gt;") == "a\nb" and html.html_text("a &lt; b") == "a &lt; b"
    body = "\n".join("x" * 99 for _ in range(200))
    parts = html.chunks(body)
    assert all(len(t) <= 6000 and body[s:e] == t for t, s, e in parts) and "".join(t for t, _, _ in parts).replace("\n", "") == body.replace("\n", "")
    assert html.chunks("") == [("", 0, 0)]


def test_sitemap_and_robots():
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/1</loc><lastmod>2026-07-01</lastmod></url><url><loc>http://a.example/2</loc></url><url><loc>https://b.example/3</loc></url></urlset>'
    assert crawl.sitemap(gzip.compress(xml), "a.example") == crawl.sitemap(xml, "a.example") == ([("https://a.example/1", "2026-07-01")], [])
    rules = "User-agent: *\nDisallow: /companies/\nAllow: /companies/*/projects$ # ok\nUser-agent: x\nDisallow: /\n"
    assert crawl.robots_allow(rules, "/companies/a/projects") and not crawl.robots_allow(rules, "/companies/a") and crawl.robots_allow("", "/z") and not crawl.robots_allow("", "/z", only="^/companies/")


def test_leads():
    page = f'<script type="application/ld+json">{json.dumps([{**POSTING, "url": "https://y.example/details/5"}])}</script><nav class="pagination"><a href="/sitemap/area/2">n</a><a href="/other">o</a></nav>'
    found, further = crawl.listing_leads(page, "https://y.example/sitemap/area/1", "y.example", r"/details/(\d+)$", r"^/sitemap/")
    assert found[0]["external_id"] == "5" and found[0]["location"] == "東京都 港区" and further == ["https://y.example/sitemap/area/2"]
    assert crawl.detail_lead(page, "https://y.example/details/5", r"/details/(\d+)")["company"] == "Acme"
    data = {"body": {"company": {"company_path": "/companies/a", "project_count": 2}, "projects": [{"id": 1, "title": "t", "category": "normal", "published_at": "2026-07-01"}, {"id": 2, "title": "u", "category": "event", "published_at": "x"}]}}
    assert [p["external_id"] for p in crawl.embedded_projects(f'<script id="ssr-app-data">{json.dumps(data)}</script>', "a")] == ["1"]
    rows = crawl.directory_rows('<table><tr><th><a href="/company/detail/9.html">N</a></th><td><img alt="英語対応可能"><ul><li>IT</li></ul></td></tr></table>', "https://d.example", r"/detail/(\d+)\.html")
    assert rows == [{"external_key": "9", "name": "N", "url": "https://d.example/company/detail/9.html", "signals": ["英語対応可能"], "labels": ["IT"]}]


def test_backlinks(spark):
    graph = spark.createDataFrame([("https://acme.jp/", "https://www.acme.jp/recruit"), ("https://www.acme.jp/recruit", "https://jobs.lever.co/acme"), ("https://evil.jp/", "https://jobs.lever.co/acme2")], "url string, link string")
    sites = spark.createDataFrame([("A", "https://acme.jp/", "lever", "acme"), ("E", "https://acme.jp/", "lever", "acme2")], "company string, url string, kind string, tenant string")
    assert [r.company for r in crawl.verified_by_backlink(sites, graph).collect()] == ["A"]


def test_objects(spark, tmp_path):
    store = objects.RawObjects(spark, f"file://{tmp_path}")
    blobs = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "bytes binary")
    assert (store.put_if_absent(blobs), store.put_if_absent(blobs)) == (2, 0)
    key = spark.range(1).select(F.sha2(F.lit(b"a"), 256).alias("hash"))
    assert store.get(key.first().hash) == b"a"
    store.delete(key)
    store.delete(key)
    assert store.get(key.first().hash) is None
    with pytest.raises(ValueError):
        objects.key_of("../etc")


def test_markdown(spark):
    table = objects.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n"), "Title")
    assert table == "# Title\n\n| n | s |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |\n"


def test_search_queries_rotate(spark):
    shards = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "place int, shard string")
    plain = [f'"{h}" in:file s{i}' for k, h in crawl.SEARCH_HOSTS.items() for i in range(4 if k == "workday" else 3)][:10]
    for seed in (0, 3, 13, -1):
        got = [r.query for r in crawl.search_queries(shards, seed, most=10).orderBy("place").collect()]
        assert got == plain[seed % 10 :] + plain[: seed % 10]
    assert crawl.search_queries(shards.where("false")).count() == 0
