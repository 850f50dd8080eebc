"""Queries of collecting: platform pages, sitemaps, leads, directories, backlinks, raw objects. The pages are built from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text, urls
from factloom.plans.catalog import query
from factloom.session import spread
from factloom.session import table as t
from factloom.sources import connectors, crawl, html


def each_row(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that f makes of each row, in batches."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for record in b.to_dict("records") for r in f(record)]
            yield pd.DataFrame(rows, columns=columns)

    return df.mapInPandas(run, schema)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as one page of a platform; the nation's number chooses the platform."""
    k, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    s = lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    url = F.concat(F.lit("https://x.example/"), k)
    job = F.struct(
        k.alias("id"), url.alias("absolute_url"), url.alias("postingUrl"), url.alias("hostedUrl"), url.alias("jobUrl"), url.alias("externalPath"), name.alias("title"), name.alias("name"), name.alias("text"),
        s(name=F.lit("Tokyo"), fullLocation=F.lit("Tokyo")).alias("location"), s(location=F.lit("Tokyo")).alias("categories"), F.lit("2026-07-01").alias("first_published"), F.lit("2026-07-01").alias("releasedDate"))
    kinds = F.array(*map(F.lit, ("greenhouse", "smartrecruiters", "lever", "workday")))
    grouped = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    n, j = F.col("s_nationkey"), F.col("jobs")
    total = F.size("jobs")
    kind = F.get(kinds, n % 4)
    body = F.when(n % 4 == 0, F.to_json(F.struct(j.alias("jobs"), F.struct(total.alias("total")).alias("meta")))).when(n % 4 == 1, F.to_json(F.struct(j.alias("content"), total.alias("totalFound")))).when(n % 4 == 2, F.to_json(j)).otherwise(F.to_json(F.struct(j.alias("jobPostings"), total.alias("total"))))
    return grouped.select(n.cast("string").alias("source_id"), kind.alias("kind"), F.concat(F.lit("t"), n.cast("string")).alias("tenant"), F.lit("r").alias("run_id"), F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("cursor"), body.alias("body"))


@query("SRC-01", "SRC-02", "SRC-03", "SRC-05", "JSN-06", oracle="""
    SELECT s_nationkey::VARCHAR AS source_id, ['greenhouse', 'smartrecruiters', 'lever', 'workday'][s_nationkey % 4 + 1] || ':t' || s_nationkey || ':' || s_suppkey AS stable_key, s_name AS title, CASE WHEN s_nationkey % 4 < 3 THEN 'Tokyo' END AS location,
        CASE WHEN s_nationkey % 4 < 2 THEN '2026-07-01' END AS published FROM supplier""")
def platform_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = each_row(_pages(spark, d), connectors.page_rows, connectors.ROW)
    return rows.where("stable_key is not null").select("source_id", "stable_key", "title", "location", "published")


_POSTING = """<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"%s","url":"%s","hiringOrganization":{"name":"%s"},"jobLocation":{"address":{"addressRegion":"%s"}},"datePosted":"2026-07-01"}]}</script>"""


def _posting(title: Column, url: Column, company: Column, place: Column) -> Column:
    return F.format_string(_POSTING, title, url, company, place)


@query("SRC-08", "SRC-12", "SRC-13", "JSN-04", "JSN-05", oracle="""
    SELECT c_custkey, c_custkey::VARCHAR AS external_id, c_name AS title, c_mktsegment AS company, '東京都' AS location FROM customer""")
def posting_leads(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages with JSON-LD as leads."""
    url = F.concat(F.lit("https://y.example/details/"), F.col("c_custkey").cast("string"))
    pages = t(spark, d, "customer").select("c_custkey", url.alias("url"), _posting(F.col("c_name"), url, F.col("c_mktsegment"), F.lit("東京都")).alias("html"))

    def lead(r: dict) -> Iterator[tuple]:
        if x := crawl.detail_lead(r["html"], r["url"], r"/details/(\d+)$"):
            yield r["c_custkey"], x["external_id"], x["title"], x["company"], x["location"]

    return each_row(pages, lead, "c_custkey long, external_id string, title string, company string, location string")


@query("SRC-10", "SRC-15", "PRO-14", oracle="""
    SELECT n_regionkey, 'https://a.example/' || n_nationkey AS url, n_nationkey % 3 <> 0 AS allowed FROM nation WHERE n_nationkey % 2 = 0""")
def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap for each region, kept to one host over https, with what robots rules let read."""
    k = F.col("n_nationkey").cast("string")
    entry = F.concat(F.lit("<url><loc>"), F.when(F.col("n_nationkey") % 2 == 0, "https://a.example/").otherwise("http://a.example/"), k, F.lit("</loc></url>"))
    ban = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Disallow: /"), k, F.lit("$\n"))).otherwise("")
    maps = t(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"), F.concat(F.lit("User-agent: *\n"), F.array_join(F.collect_list(ban), "")).alias("robots"))

    def pages(r: dict) -> Iterator[tuple]:
        for url, _ in crawl.sitemap(r["xml"].encode(), "a.example")[0]:
            yield r["n_regionkey"], url, crawl.robots_allow(r["robots"], url.removeprefix("https://a.example"))

    return each_row(maps, pages, "n_regionkey int, url string, allowed boolean")


@query("SRC-14", "SRC-16", oracle="""
    SELECT 'project' AS kind, s_nationkey AS owner, s_suppkey::VARCHAR AS external_key, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'company', n_regionkey, n_nationkey::VARCHAR, n_name FROM nation""")
def embedded_and_directory(spark: SparkSession, d: str) -> DataFrame:
    """Projects out of the data that company pages carry, and rows of directory tables."""
    k = F.col("s_suppkey")
    project = F.struct(k.cast("int").alias("id"), F.col("s_name").alias("title"), F.when(k % 2 == 0, "normal").otherwise("event").alias("category"), F.lit("2026-07-01").alias("published_at"))
    grouped = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(project).alias("projects"))
    company = F.struct(F.concat(F.lit("/companies/c"), F.col("s_nationkey").cast("string")).alias("company_path"), F.size("projects").alias("project_count"))
    pages = grouped.select(F.col("s_nationkey").alias("owner"), F.concat(F.lit('<script id="ssr-app-data">'), F.to_json(F.struct(F.struct(company.alias("company"), F.col("projects")).alias("body"))), F.lit("</script>")).alias("html"))
    row = F.concat(F.lit('<tr><th><a href="/company/detail/'), F.col("n_nationkey").cast("string"), F.lit('.html">'), F.col("n_name"), F.lit("</a></th></tr>"))
    tables = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("owner")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    schema = "kind string, owner int, external_key string, name string"

    def projects(r: dict) -> Iterator[tuple]:
        return (("project", r["owner"], x["external_id"], x["title"]) for x in crawl.embedded_projects(r["html"], f"c{r['owner']}"))

    def companies(r: dict) -> Iterator[tuple]:
        return (("company", r["owner"], x["external_key"], x["name"]) for x in crawl.directory_rows(r["html"], "https://d.example", r"/detail/(\d+)\.html"))

    return each_row(pages, projects, schema).union(each_row(tables, companies, schema))


@query("SRC-19", "JSN-07", oracle="""
    SELECT 'c' || s_suppkey AS company, 'lever' AS kind, 't' || s_suppkey AS tenant FROM supplier WHERE s_suppkey % 3 = 0""")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Every third company's own pages lead, in two steps, to the tenant that is claimed for it."""
    k = F.col("s_suppkey").cast("string")
    home, inner = F.concat(F.lit("https://c"), k, F.lit(".jp/")), F.concat(F.lit("https://www.c"), k, F.lit(".jp/recruit"))
    away = F.concat(F.lit("https://jobs.lever.co/t"), F.when(F.col("s_suppkey") % 3 == 0, k).otherwise(F.concat(k, F.lit("x"))))
    s = t(spark, d, "supplier")
    graph = s.select(home.alias("url"), inner.alias("link")).union(s.select(inner.alias("url"), away.alias("link")))
    sites = s.select(F.concat(F.lit("c"), k).alias("company"), home.alias("url"), F.lit("lever").alias("kind"), F.concat(F.lit("t"), k).alias("tenant"))
    return crawl.verified_by_backlink(sites, graph)


@query("SNK-01", "DML-01", oracle="""SELECT sha256(html) AS hash, 'raw/sha256/' || substr(sha256(html), 1, 2) || '/' || sha256(html) AS key, min(strlen(html)) AS bytes FROM pages GROUP BY html""")
def raw_objects(spark: SparkSession, d: str) -> DataFrame:
    """What a put of all pages would store: each content once, under its hash."""
    raw = F.encode("html", "UTF-8")
    hashed = t(spark, d, "pages").select(text.raw_hash(raw).alias("hash"), F.octet_length(raw).cast("long").alias("bytes"))
    return hashed.groupBy("hash").agg(F.min("bytes").alias("bytes")).select("hash", F.concat(F.lit("raw/sha256/"), F.substring("hash", 1, 2), F.lit("/"), "hash").alias("key"), "bytes")


@query("DOC-04", "DOC-05", "JSN-01", "JSN-02", "JSN-03", "CLS-08", oracle="""
    SELECT p_partkey, unnest(['title', 'location', 'responsibilities', 'skills']) AS kind, unnest([p_name, 'Tokyo', p_type || ' work to be done', p_brand]) AS text FROM part""")
def json_sections(spark: SparkSession, d: str) -> DataFrame:
    """JSON answers as sections: the job under its wrapper, keys at any depth, each text once a kind."""
    body = F.to_json(F.struct(F.struct(F.col("p_name").alias("title"), F.struct(F.lit("Tokyo").alias("location")).alias("place"), F.concat(F.lit("<p>"), "p_type", F.lit(" work to be done</p>")).alias("description"), F.array("p_brand").alias("skills")).alias("jobPosting")))
    found = html.sections(spread(t(spark, d, "part")).select("p_partkey", body.alias("raw")), "p_partkey", "raw", "lever")
    return found.where("error is null and kind in ('title', 'location', 'responsibilities', 'skills') and locator not rlike '^[$][.]place$'").select("p_partkey", "kind", "text")


@query("PRO-10", "PRO-19", "RAG-04", oracle="""
    SELECT s_suppkey, s_suppkey % 2 = 0 AS same, s_suppkey % 3 = 0 AS known, s_suppkey < 10 AS reported FROM supplier""")
def identity_checks(spark: SparkSession, d: str) -> DataFrame:
    """Repository and tenant are one by mutual containment of their letters and digits; ids are among the known ones."""
    from factloom.operators.retrieval import only_known

    k = F.col("s_suppkey")
    repo, tenant = text.ascii_name(F.concat(F.lit("Acme-"), k.cast("string"))), text.ascii_name(F.concat(F.when(k % 2 == 0, "acme").otherwise("other"), k.cast("string"), F.lit("-careers")))
    same = (F.char_length(repo) >= 4) & (F.contains(tenant, repo) | F.contains(repo, tenant))
    known = only_known(F.array(k % 3, F.lit(0).cast("long")), F.array(F.lit(0).cast("long")))
    return t(spark, d, "supplier").select("s_suppkey", same.alias("same"), known.alias("known"), (k < 10).alias("reported"))


@query("STA-23", oracle="""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@query("SRC-09", "JSN-07", oracle="""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://corp' || page_id || '.example/' END AS company_url, page_id % 2 = 0 AS safe FROM pages""")
def company_urls(spark: SparkSession, d: str) -> DataFrame:
    """The first https URL of a posting that is on no platform, and whether a page may be fetched at all."""
    k = F.col("page_id").cast("string")
    candidates = F.array(F.concat(F.lit("https://jobs.lever.co/a"), k), F.lit("http://plain.example/"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://corp"), k, F.lit(".example/"))))
    own = F.get(F.filter(F.array_compact(candidates), lambda u: u.startswith("https://") & urls.detect_source(u).isNull()), 0)
    url = F.when(F.col("page_id") % 2 == 0, "https://ok.example/").when(F.col("page_id") % 4 == 1, "https://user:pw@ok.example/").otherwise("http://ok.example/")
    return t(spark, d, "pages").select("page_id", own.alias("company_url"), urls.is_safe_url(url).alias("safe"))

