"""Queries that grow the set of sources: seeds, imports, audits, collections of several pages, and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import urls
from factloom.operators import combine, expansion, tables
from factloom.plans.catalog import query
from factloom.plans.collect import each_row
from factloom.session import scratch
from factloom.session import table as t
from factloom.sources import connectors

_SEEDS = """
    WITH s AS (SELECT c_custkey AS place, ['lever', 'ashby', 'workday'][1 + c_custkey % 3] AS kind, CASE WHEN c_custkey % 3 = 2 THEN 'T' || (c_custkey % 40) || '.wd1.myworkdayjobs.com/jobs' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'T' ELSE 't' END || (c_custkey % 70) || CASE WHEN c_custkey % 11 = 0 THEN '/bad' ELSE '' END END AS tenant,
        CASE WHEN c_custkey % 5 < 2 THEN c_name END AS company_name, CASE WHEN c_custkey % 7 = 3 THEN 'https://r.example/' || c_custkey END AS referrer_url, c_custkey % 4 = 0 AS japan_signal FROM customer),
    v AS (SELECT *, lower(tenant) AS tenant_key FROM s)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    plain = F.concat(F.when(k % 2 == 0, "T").otherwise("t"), text(k % 70), F.when(k % 11 == 0, "/bad").otherwise(""))
    tenant = F.when(k % 3 == 2, F.concat(F.lit("T"), text(k % 40), F.lit(".wd1.myworkdayjobs.com/jobs"))).otherwise(plain)
    kind = F.when(k % 3 == 0, "lever").when(k % 3 == 1, "ashby").otherwise("workday")
    return t(spark, d, "customer").select(k.alias("place"), kind.alias("kind"), tenant.alias("tenant"), F.when(k % 5 < 2, F.col("c_name")).alias("company_name"), F.when(k % 7 == 3, F.concat(F.lit("https://r.example/"), text(k))).alias("referrer_url"), (k % 4 == 0).alias("japan_signal"))


@query("PRO-07", "DUP-06", oracle=_SEEDS + """,
    m AS (SELECT kind, arg_max(tenant, place) AS tenant, arg_min(company_name, place) FILTER (company_name IS NOT NULL) AS company_name, arg_min(referrer_url, place) FILTER (referrer_url IS NOT NULL) AS referrer_url FROM v WHERE tenant NOT LIKE '%/bad' GROUP BY kind, tenant_key)
    SELECT *, row_number() OVER (ORDER BY company_name IS NULL, kind, tenant COLLATE en, tenant) AS place_ FROM m""")
def seeds_merged(spark: SparkSession, d: str) -> DataFrame:
    """Customers as seeds of tenants that others name in another case; named ones first."""
    return expansion.merged_seeds(_seeds(spark, d)).withColumnRenamed("rank", "place_")


def _artifact(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("place")
    locator = F.map_from_arrays(F.array(F.lit("place"), F.concat(F.lit("p"), (k % 2).cast("string"))), F.array(k.cast("string"), k.cast("string")))
    return _seeds(spark, d).withColumns({"source_url": F.concat(F.lit("https://s.example/"), k.cast("string")), "locator": locator, "referrer_basis": F.when(F.col("referrer_url").isNotNull(), "page")})


@query("PRO-17", "STA-22", "DML-02", oracle=_SEEDS + """,
    g AS (SELECT kind, tenant_key, count(*) AS n, count(*) FILTER (japan_signal) AS japan, count(referrer_url) AS refs, tenant_key IN (SELECT tenant_key FROM v w WHERE w.kind = v.kind AND w.place % 2 = 0) AS known FROM v GROUP BY kind, tenant_key)
    SELECT kind, sum(n)::BIGINT AS candidates, coalesce(sum(n) FILTER (NOT known), 0)::BIGINT AS would_insert, coalesce(sum(n) FILTER (known), 0)::BIGINT AS would_update, count(*) FILTER (NOT known) AS inserted, (sum(n) - count(*) FILTER (NOT known))::BIGINT AS updated,
        sum(japan)::BIGINT AS japan_signals, sum(refs)::BIGINT AS official_referrers, sum(n)::BIGINT AS least_requests, (120 * sum(n))::BIGINT AS most_requests FROM g GROUP BY kind""")
def tenants_import_report(spark: SparkSession, d: str) -> DataFrame:
    """Report of an import of all tenants into a store that had those of every other customer."""
    store = tables.BucketTable(spark, scratch(spark, "tenants"), ["kind", "tenant_key"], buckets=8)
    artifact = _artifact(spark, d)
    expansion.import_tenants(store, artifact.where("place % 2 = 0"), apply=True)
    return expansion.import_tenants(store, artifact, apply=True)


@query("PRO-17", "DML-03", "DML-04", "JSN-08", oracle=_SEEDS + """,
    e AS (SELECT *, row_number() OVER (ORDER BY place % 2, place) AS seq FROM v),
    l AS (SELECT kind, tenant_key, k, arg_max(place, seq) AS x FROM (SELECT *, unnest(['place', 'p' || (place % 2)]) AS k FROM e) GROUP BY ALL), m AS (SELECT kind, tenant_key, string_agg(k || '=' || x, ',' ORDER BY k) AS locator FROM l GROUP BY ALL)
    SELECT kind, tenant_key, arg_min(tenant, seq) AS tenant, arg_min(company_name, seq) FILTER (company_name IS NOT NULL) AS company_name, 'https://s.example/' || arg_max(place, seq) AS source_url, any_value(locator) AS locator, bool_or(japan_signal) AS japan_signal, arg_min(referrer_url, seq) FILTER (referrer_url IS NOT NULL) AS referrer_url
    FROM e JOIN m USING (kind, tenant_key) GROUP BY kind, tenant_key""")
def tenants_imported(spark: SparkSession, d: str) -> DataFrame:
    """What two imports leave: first names and referrers, last URLs, locators with the keys of both; a dry run between them changes nothing."""
    store = tables.BucketTable(spark, scratch(spark, "tenants"), ["kind", "tenant_key"], buckets=8)
    artifact = _artifact(spark, d)
    expansion.import_tenants(store, artifact.where("place % 2 = 0"), apply=True)
    expansion.import_tenants(store, artifact, apply=False)
    expansion.import_tenants(store, artifact.where("place % 2 = 1"), apply=True)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("locator")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return store.rows().select("kind", "tenant_key", "tenant", "company_name", "source_url", shown.alias("locator"), "japan_signal", "referrer_url")


@query("PRO-06", "PRO-05", oracle=r"""
    WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS href FROM pages), u AS (SELECT DISTINCT page_id % 50 AS company, 'https://example.com/jobs' || href AS url FROM l),
    s AS (SELECT company, url, 100 + CASE WHEN regexp_matches(lower(url), 'career|recruit|採用|求人|募集') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'guideline|requirement|recruitment|detail|information') THEN 25 ELSE 0 END
        - CASE WHEN regexp_matches(lower(url), 'contact|entry|interview|message|about|welfare|faq|voice|member|data|environment|privacy|news|blog|twitter|facebook') THEN 60 ELSE 0 END - CASE WHEN regexp_matches(url, '\.(pdf|jpg|jpeg|png)$') THEN 100 ELSE 0 END AS score FROM u),
    q AS (SELECT company FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY company ORDER BY score DESC, url) <= 6), f AS (SELECT company, unnest(CASE company % 3 WHEN 0 THEN ['lever'] WHEN 1 THEN ['lever', 'ashby'] ELSE [] END) AS kind FROM q)
    SELECT kind, count(*) AS n, (SELECT count(*) FROM q) AS requests, (SELECT count(DISTINCT company) FROM f) AS companies FROM f GROUP BY kind""")
def links_audited(spark: SparkSession, d: str) -> DataFrame:
    """The best links of fifty companies' pages, audited: sources of the platforms that each names, by kind."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1), lambda h: F.concat(F.lit("https://example.com/jobs"), h))
    queue = expansion.audit_queue(t(spark, d, "pages").select((F.col("page_id") % 50).alias("company"), hrefs.alias("links")), "company", "links")
    named = F.when(F.col("company") % 3 == 0, F.array(F.lit("https://jobs.lever.co/a"))).when(F.col("company") % 3 == 1, F.array(F.lit("https://jobs.lever.co/a"), F.lit("https://jobs.ashbyhq.com/b"))).otherwise(F.array(F.lit("https://none.example/")))
    sources = F.filter(F.transform(named, urls.detect_source), lambda s: s.isNotNull())
    return expansion.audit_report(queue.withColumn("sources", sources), "company", "sources")


@query("PRO-14", "DAT-06", "SRC-15", oracle="""
    WITH l AS (SELECT o_custkey % 25 AS tenant, o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS day FROM orders), w AS (SELECT *, day BETWEEN DATE '1996-06-01' - 183 AND DATE '1996-06-01' AS ok FROM l)
    SELECT tenant, count(*) AS projects, count(*) FILTER (ok) AS eligible, count(*) FILTER (ok AND o_orderkey % 4 > 0) AS inserted, count(*) FILTER (NOT ok) AS outside_window, count(*) FILTER (day IS NULL) AS unknown_publication FROM w GROUP BY tenant""")
def collection_windows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects of tenants whose pages robots.txt lets be read: eligible by the window, new, and left out by reason."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/companies/t"), (F.col("o_custkey") % 25).cast("string"), F.lit("/projects"))
    leads = t(spark, d, "orders").select((F.col("o_custkey") % 25).alias("tenant"), k, "o_orderdate", path.alias("path"), F.lit("User-agent: *\nDisallow: /\nAllow: /companies/").alias("robots"))
    let = expansion.robots_gate(leads.select("tenant", "path", "robots").distinct(), "robots", "path").select("tenant")
    published = F.when(k % 7 > 0, F.to_date("o_orderdate"))
    return expansion.window_report(leads.join(let, "tenant"), "tenant", published, k % 4 == 0, 183, F.lit("1996-06-01 12:00:00").cast("timestamp"))


@query("FIL-09", oracle="""
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus = 'O' AS eligible, o_orderkey % 3 = 0 AS saved, o_orderkey % 5 = 0 AS applied, o_orderkey % 7 = 0 AS hidden, o_orderkey % 2 = 0 AS told FROM orders),
    s AS (SELECT k, eligible, told AND saved AS saved, told AND applied AS applied, told AND hidden AS hidden FROM o)
    SELECT k AS o_orderkey, view FROM s, (SELECT unnest(['saved', 'applied', 'hidden', 'recommendations']) AS view) WHERE CASE view WHEN 'saved' THEN saved AND NOT hidden WHEN 'applied' THEN applied AND NOT hidden WHEN 'hidden' THEN hidden ELSE eligible AND NOT hidden END""")
def jobs_in_views(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs, every other with a user's state, filtered by each view."""
    k = F.col("o_orderkey")
    orders = t(spark, d, "orders")
    states = orders.where(k % 2 == 0).select(k, (k % 3 == 0).alias("saved"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("applied_at"), (k % 7 == 0).alias("hidden"))
    jobs = orders.select(k, (F.col("o_orderstatus") == "O").alias("eligible")).join(states, "o_orderkey", "left")
    each = jobs.withColumn("view", F.explode(F.array(*[F.lit(v) for v in ("saved", "applied", "hidden", "recommendations")])))
    return each.where(expansion.in_view(F.col("view"), F.col("eligible"), F.col("saved"), F.col("applied_at"), F.col("hidden"))).select("o_orderkey", "view")


@query("AGG-13", "SRT-04", oracle="""
    WITH c AS (SELECT ['い', 'ア', 'a', '漢', 'B', 'あ', '横浜', '東京'][1 + doc_id % 8] || lang AS key, count(*) AS n FROM documents GROUP BY 1) SELECT key, n, row_number() OVER (ORDER BY n DESC, key COLLATE ja, key) AS place FROM c""")
def ranked_keys(spark: SparkSession, d: str) -> DataFrame:
    """A histogram of Japanese and other names: the largest first, equal ones in the Japanese order."""
    names = F.array(*[F.lit(x) for x in ("い", "ア", "a", "漢", "B", "あ", "横浜", "東京")])
    key = F.concat(F.get(names, (F.col("doc_id") % 8).cast("int")), "lang")
    return combine.ranked_histogram(t(spark, d, "documents"), key).withColumnRenamed("rank", "place")


@query("SRC-07", "DUP-01", oracle="""
    SELECT s_nationkey::VARCHAR AS source_id, 'jobcan:t' || s_nationkey || ':' || s_suppkey AS stable_key, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'late ' || s_name END AS title, count(*) OVER (PARTITION BY s_nationkey) AS provider_total,
        (SELECT count(DISTINCT x.s_suppkey % 3) FROM supplier x WHERE x.s_nationkey = supplier.s_nationkey AND x.s_suppkey % 3 > 0) AS categories FROM supplier""")
def category_collections(spark: SparkSession, d: str) -> DataFrame:
    """A platform whose first page names some jobs and links to pages by category with the others and some again; jobs count once, as their last page has them."""
    n, k, c = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    link = lambda label: F.concat(F.lit('<a href="/t'), n, F.lit("/job_offers/"), k, F.lit('">'), label, F.lit("</a>"))
    category = F.concat(F.lit('<a href="/t'), n, F.lit("/list?category_id="), c.cast("string"), F.lit('&amp;x=1">more</a>'))
    suppliers = t(spark, d, "supplier")
    # the first page has all jobs, under names that the pages of categories 1 and 2 change
    first = suppliers.select("s_nationkey", F.lit(0).alias("page"), F.concat(link(F.col("s_name")), F.when(c > 0, category).otherwise("")).alias("part"))
    later = suppliers.where(c > 0).select("s_nationkey", c.cast("int").alias("page"), link(F.concat(F.lit("late "), "s_name")).alias("part"))
    bodies = first.union(later).groupBy("s_nationkey", "page").agg(F.array_join(F.collect_list("part"), "\n").alias("body"))
    pages = bodies.select(n.alias("source_id"), F.lit("jobcan").alias("kind"), F.concat(F.lit("t"), n).alias("tenant"), F.lit("r").alias("run_id"), (F.col("page") + 1).alias("page_no"), F.lit(None).cast("string").alias("cursor"), "body")
    categories = each_row(pages.where("page_no = 1"), connectors.category_urls, "source_id string, run_id string, url string").groupBy("source_id").agg(F.count(F.lit(1)).alias("categories"))
    whole = connectors.whole_collections(each_row(pages, connectors.page_rows, connectors.ROW))
    return whole.join(categories, "source_id", "left").select("source_id", "stable_key", "title", "provider_total", F.coalesce("categories", F.lit(0)).alias("categories"))


@query("SRC-07", "SRC-10", oracle="""
    SELECT DISTINCT 't' || (s_suppkey % 13) AS tenant, s_suppkey::VARCHAR AS external_id, 'https://open.talentio.com/r/1/c/t' || (s_suppkey % 13) || '/pages/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 13 < 10 AND s_suppkey % 4 > 0""")
def sitemap_collections(spark: SparkSession, d: str) -> DataFrame:
    """Job pages of wanted tenants in sitemaps that name those of all, twice, with other pages and hosts among them."""
    k = F.col("s_suppkey")
    host = F.when(k % 4 == 0, "https://other.example").otherwise("https://open.talentio.com")
    url = F.concat(host, F.lit("/r/1/c/t"), (k % 13).cast("string"), F.lit("/pages/"), k.cast("string"))
    entry = F.concat(F.lit("<url><loc>\n"), url, F.when(k % 2 == 0, "/").otherwise(""), F.lit(" </loc></url><url><loc>https://open.talentio.com/about</loc></url>"))
    maps = t(spark, d, "supplier").select(F.explode(F.array(k % 5, k % 7)).alias("part"), entry.alias("entry")).groupBy("part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("entry"), ""), F.lit("</urlset>")).alias("body"))
    wanted = spark.range(10).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tenant"))
    return connectors.sitemap_records(maps, "body", wanted)
