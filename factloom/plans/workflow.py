"""Queries of collecting and keeping state that the other modules leave open: platforms of links, seeds, harvests, snapshots, logs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import jobs, text, urls
from factloom.operators import facts, retrieval, scoring, tables
from factloom.operators.ranking import global_rank
from factloom.plans.catalog import query
from factloom.plans.collect import each_row
from factloom.session import scratch
from factloom.session import table as t
from factloom.sources import connectors, crawl, objects
from factloom.streaming import state


def _recorded(grouped: DataFrame, kind: str, body) -> DataFrame:
    n = F.col("s_nationkey").cast("string")
    return grouped.select(n.alias("source_id"), F.lit(kind).alias("kind"), F.concat(F.lit("t"), n).alias("tenant"), F.lit("r").alias("run_id"), F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("cursor"), body.alias("body"))


@query("SRC-00", oracle="""SELECT s_suppkey::VARCHAR AS external_id, s_name AS title, 'lever:t' || s_nationkey || ':' || s_suppkey AS stable_key FROM supplier""")
def recorded_source(spark: SparkSession, d: str) -> DataFrame:
    """Pages recorded as JSON lines in the shared folder, read by the data source."""
    k, path = F.col("s_suppkey").cast("string"), scratch(spark, "recorded")
    job = F.struct(k.alias("id"), F.col("s_name").alias("text"))
    _recorded(t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(job).alias("jobs")), "lever", F.to_json("jobs")).write.json(path)
    return connectors.recorded_pages(spark, path).select("external_id", "title", "stable_key")


@query("SRC-04", oracle="""
    SELECT s_nationkey::VARCHAR AS source_id, 'ashby:t' || s_nationkey || ':' || s_suppkey AS stable_key, s_name AS title, 'Tokyo, Osaka' AS location, '2026-07-01' AS published FROM supplier WHERE s_suppkey % 2 = 1""")
def ashby_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a platform that also lists what it does not show."""
    k, s = F.col("s_suppkey"), t(spark, d, "supplier")
    job = F.struct(k.cast("string").alias("id"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("jobUrl"), F.col("s_name").alias("title"), F.lit("Tokyo").alias("location"), F.array(F.struct(F.lit("Osaka").alias("location"))).alias("secondaryLocations"), F.lit("2026-07-01").alias("publishedAt"), (k % 2 == 1).alias("isListed"))
    pages = _recorded(s.groupBy("s_nationkey").agg(F.collect_list(job).alias("jobs")), "ashby", F.to_json(F.struct("jobs")))
    return each_row(pages, connectors.page_rows, connectors.ROW).where("stable_key is not null").select("source_id", "stable_key", "title", "location", "published")


@query("SRC-06", "SRC-07", oracle="""
    SELECT s_nationkey::VARCHAR AS source_id, CASE WHEN s_nationkey % 2 = 0 THEN 'hrmos' ELSE 'herp' END || ':t' || s_nationkey || ':' || s_suppkey AS stable_key, s_name AS title, CASE WHEN s_nationkey % 2 = 0 THEN count(*) OVER (PARTITION BY s_nationkey) END AS provider_total FROM supplier""")
def platforms_of_links(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of platforms that list them as links, one with a counter and one without."""
    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    even = F.col("s_nationkey") % 2 == 0
    href = F.when(even, F.concat(F.lit("/pages/t"), n, F.lit("/jobs/"), k)).otherwise(F.concat(F.lit("/v1/t"), n, F.lit("/"), k))
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), F.col("s_name"), F.lit("</a>"))
    grouped = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(link).alias("links"))
    body = F.concat(F.lit('<span id="jsi-total-count">'), F.size("links").cast("string"), F.lit("</span>"), F.array_join("links", "\n"))
    pages = _recorded(grouped.where(even), "hrmos", body).union(_recorded(grouped.where(~even), "herp", body))
    return each_row(pages, connectors.page_rows, connectors.ROW).where("stable_key is not null").select("source_id", "stable_key", "title", "provider_total")


@query("SRC-11", oracle="""
    SELECT s_nationkey AS page, s_suppkey::VARCHAR AS external_id, s_name AS title, 'https://y.example/list/' || s_nationkey || '?page=2' AS further FROM supplier WHERE s_suppkey % 3 > 0""")
def listing_leads(spark: SparkSession, d: str) -> DataFrame:
    """Leads and the next page of an aggregator's lists; postings of another host are none."""
    k = F.col("s_suppkey")
    host = F.when(k % 3 > 0, "https://y.example/details/").otherwise("https://z.example/details/")
    item = F.struct(F.lit("JobPosting").alias("@type"), F.col("s_name").alias("title"), F.concat(host, k.cast("string")).alias("url"))
    lists = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(item).alias("itemListElement"))
    url = F.concat(F.lit("https://y.example/list/"), F.col("s_nationkey").cast("string"))
    ld = F.to_json(F.struct(F.lit("ItemList").alias("@type"), "itemListElement"))
    markup = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit('</script><nav class="pagination"><a href="'), url, F.lit('?page=2">2</a></nav>'))

    def leads(r: dict) -> Iterator[tuple]:
        found, further = crawl.listing_leads(r["html"], r["url"], "y.example", r"/details/(\d+)$", "/list/")
        return ((r["s_nationkey"], x["external_id"], x["title"], further[0]) for x in found)

    return each_row(lists.select("s_nationkey", url.alias("url"), markup.alias("html")), leads, "page int, external_id string, title string, further string")


@query("SRC-17", oracle="""
    SELECT n_nationkey, 'https://c.example/' || CASE n_nationkey % 3 WHEN 0 THEN 'recruit' WHEN 1 THEN 'x' END AS url FROM nation WHERE n_nationkey % 3 < 2""")
def job_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that speak of jobs by their path or by their text."""
    k = F.col("n_nationkey")
    link = F.when(k % 3 == 0, '<a href="/recruit">about</a>').when(k % 3 == 1, '<a href="/x">採用情報</a>').otherwise('<a href="/company">about</a>')
    pages = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit('<a href="/news">news</a>'), link).alias("html"))
    return each_row(pages, lambda r: ((r["n_nationkey"], u) for u in crawl.candidate_links(r["html"], "https://c.example/")), "n_nationkey int, url string")


@query("SRC-21", oracle=f"""
    WITH h AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{h}')" for i, (k, h) in enumerate(crawl.SEARCH_HOSTS.items()))}) v(i, kind, host)), s AS (SELECT n_nationkey AS j, 'size:' || n_nationkey AS shard FROM nation),
    q AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS spot, '"' || host || '" in:file ' || shard AS query FROM h, s WHERE kind = 'workday' OR j < 3), f AS (SELECT * FROM q WHERE spot < 30), n AS (SELECT count(*) AS n FROM f)
    SELECT ((spot - 7 % n + n) % n)::INTEGER AS place, query FROM f, n""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Searches with nations as shards, begun at the eighth."""
    return crawl.search_queries(t(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.concat(F.lit("size:"), F.col("n_nationkey").cast("string")).alias("shard")), seed=7)


@query("SRC-22", oracle="""SELECT 'lever' AS kind, 't' || n_nationkey AS "tenantKey", n_name AS "companyName" FROM nation""")
def seed_file(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a file that is there and of one that is not."""
    path = scratch(spark, "seeds")
    one = F.to_json(F.array_sort(F.collect_list(F.struct(F.lit("lever").alias("kind"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenantKey"), F.col("n_name").alias("companyName")))))
    t(spark, d, "nation").agg(one.alias("value")).write.text(path)
    return connectors.seeds(spark, path).union(connectors.seeds(spark, path + "-absent"))


@query("PRO-11", oracle="""SELECT DISTINCT 'The "' || c_mktsegment || '", Inc.' AS name FROM customer""")
def company_list(spark: SparkSession, d: str) -> DataFrame:
    """Names of a CSV file with quotes, commas and quotes inside them, and names that are too short."""
    path = scratch(spark, "companies")
    name = F.concat(F.lit('"The ""'), F.col("c_mktsegment"), F.lit('"", Inc."'))
    line = F.when(F.col("c_custkey") % 9 == 0, "1,ab,x").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(","), name, F.lit(",x")))
    header = spark.createDataFrame([("code,Company Name,note",)], "value string")
    header.union(t(spark, d, "customer").select(line)).coalesce(1).write.text(path)
    return connectors.company_names(spark, path)


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """Nations as searches, their regions as query numbers."""
    k = F.col("n_nationkey")
    found = F.array(F.struct(F.when(k % 2 == 0, "lever").otherwise("herp").alias("kind"), (k % 7).cast("string").alias("tenant")))
    return t(spark, d, "nation").select(F.col("n_regionkey").alias("query_no"), k.alias("page_no"), F.when(k >= 18, 40).otherwise(100).alias("n_items"), F.lit(False).alias("incomplete"), (F.col("n_regionkey") * 10 + k / 10).alias("ended_at"), found.alias("candidates"))


@query("PRO-12", "PRO-06", oracle="""
    WITH p AS (SELECT n_regionkey AS q, n_nationkey AS k FROM nation), l AS (SELECT q, min(k) AS last FROM p WHERE k >= 18 GROUP BY q), a AS (SELECT p.*, row_number() OVER (ORDER BY p.q, k) AS i FROM p LEFT JOIN l USING (q) WHERE last IS NULL OR k <= last), b AS (SELECT * FROM a WHERE i <= 12)
    SELECT CASE WHEN k % 2 = 0 THEN 'lever' ELSE 'herp' END AS kind, count(DISTINCT k % 7) AS candidates, (SELECT count(*) FROM b) AS requests_used, (SELECT count(*) FROM b) >= 12 AS truncated FROM b GROUP BY 1""")
def harvest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each kind, requests and whether the harvest was cut short."""
    summary, ended = crawl.harvest(_searches(spark, d), budget=12, deadline=1000.0)
    return summary.join(F.broadcast(ended))


@query("PRO-02", oracle="""
    SELECT n_nationkey AS company, 'lever' AS kind, 't' AS tenant, 'https://jobs.lever.co/t/a/b' AS url FROM nation UNION ALL SELECT n_nationkey, 'schema_org', 's', 'https://c.example/job/' || i FROM nation, (SELECT unnest([1, 2]) AS i)""")
def deepest_sources(spark: SparkSession, d: str) -> DataFrame:
    """One source for a collection, by its deepest URL; single pages by URL; a posting page of a platform is no source."""
    rows = [("lever", "t", "https://jobs.lever.co/t", True), ("lever", "t", "https://jobs.lever.co/t/a/b", True), ("lever", "t", "https://jobs.lever.co/t/a", True), ("schema_org", "s", "https://c.example/job/1", False), ("schema_org", "s", "https://c.example/job/2", False), ("schema_org", "s", "https://c.example/job/1", False), ("schema_org", "s", "https://hrmos.co/pages/t/jobs/1", False)]
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("tenant"), F.lit(u).alias("url"), F.lit(c).alias("collection")) for k, a, u, c in rows])
    each = t(spark, d, "nation").select(F.col("n_nationkey").alias("company"), F.posexplode(found).alias("place", "x")).select("company", "x.*", "place")
    return crawl.deepest_sources(each)


@query("CLS-12", oracle="""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'http_422' WHEN 1 THEN 'http_503' WHEN 2 THEN 'timeout' WHEN 3 THEN 'invalid_json' ELSE 'provider_error' END AS code, event_id % 6 NOT IN (0, 4) AS retryable FROM events""")
def provider_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    error = state.provider_error(F.when(k == 0, 422).when(k == 1, 503), F.when(k == 2, "TimeoutError").otherwise("Error"), F.when(k == 3, "Invalid JSON at 0").when(k == 4, "answer breaks its Schema").otherwise("lost"))
    return t(spark, d, "events").select("event_id", error.alias("e")).select("event_id", "e.code", "e.retryable")


@query("CLS-13", oracle="""
    WITH x AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS a, count(*) FILTER (o_orderpriority = '2-HIGH') AS b, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS c FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN a >= b AND a >= c THEN 'technology' WHEN b >= c THEN 'consultHr' ELSE 'other' END AS lane FROM x""")
def tenant_lanes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    counts = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(p == "1-URGENT").alias("p0"), F.count_if(p == "2-HIGH").alias("p1"), F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("others"))
    return counts.select("o_custkey", jobs.lane(F.col("p0"), F.col("p1"), F.col("others")).alias("lane"))


@query("STA-20", oracle="""
    WITH x AS (SELECT DISTINCT (ts + INTERVAL 9 HOUR)::DATE AS day FROM events WHERE event_type = 'purchase' AND user_id % 5 = 0)
    SELECT day, CASE WHEN EXISTS (SELECT 1 FROM x y WHERE y.day = x.day - 1) THEN 2 ELSE 1 END::INTEGER AS consecutive FROM x""")
def tokyo_days_in_a_row(spark: SparkSession, d: str) -> DataFrame:
    return state.consecutive_days(t(spark, d, "events").where("event_type = 'purchase' and user_id % 5 = 0").select("ts"), "ts")


@query("STA-01", oracle="""
    WITH x AS (SELECT s_nationkey AS n, s_suppkey AS k, count(*) OVER (PARTITION BY s_nationkey) AS total, s_nationkey % 5 = 2 AND s_suppkey % 4 = 0 AS strange FROM supplier),
    g AS (SELECT n, bool_or(k % 2 = 1) AS completed, bool_or(k % 2 = 0 AND n % 7 = 0) AS no_cursor, bool_or(n % 5 = 3) AS failed, count(DISTINCT k) FILTER (NOT strange) AS jobs, any_value(total) AS total, bool_or(strange) AS foreigners FROM x GROUP BY n)
    SELECT n::VARCHAR AS source_id, jobs, completed, array_to_string(list_filter([CASE WHEN failed THEN 'page_failed' END, CASE WHEN no_cursor THEN 'non_final_page_without_cursor' END], lambda v: v IS NOT NULL), ',') AS errors,
        CASE WHEN completed AND NOT failed AND NOT no_cursor AND NOT foreigners AND n % 5 NOT IN (1, 4) THEN 'authoritative' ELSE 'partial' END AS kind FROM g""")
def snapshot_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as two pages of a run: complete, or cut short in one of several ways."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    totals = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("total"))
    s = t(spark, d, "supplier").join(totals, "s_nationkey")
    last = k % 2 == 1
    pages = s.select(
        n.cast("string").alias("source_id"), F.lit("r").alias("run_id"), F.when(last, 2).otherwise(1).alias("page_no"), last.alias("is_last_page"), F.when(~last & (n % 7 != 0), "2").alias("next_cursor"), F.when(n % 5 == 1, F.col("total") + 1).otherwise(F.col("total")).alias("provider_total"),
        F.when((n % 5 == 2) & (k % 4 == 0), "x").otherwise(n.cast("string")).alias("row_source_id"), k.cast("string").alias("stable_key"), F.when(n % 5 == 3, "page").alias("error"))
    allowed = totals.select(n.cast("string").alias("source_id"), (n % 5 != 4).alias("allows"))
    previous = spark.createDataFrame([], "source_id string, stable_key string")
    done = state.finalise_snapshots(pages, allowed, previous)
    return done.select("source_id", F.col("jobs").cast("long").alias("jobs"), "completed", F.array_join("parse_errors", ",").alias("errors"), "kind")


@query("STA-04", oracle="""
    SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'active' END AS from_state, CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'active' END AS to_state FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def state_log(spark: SparkSession, d: str) -> DataFrame:
    """Log rows of changed states, new keys among them."""
    c = t(spark, d, "customer")
    old, new = c.where("c_custkey % 5 > 0").select("c_custkey", F.lit("active").alias("state")), c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "closed").otherwise("active").alias("state"))
    return state.transitions(old, new, "c_custkey", F.lit("2026-07-01").cast("timestamp_ntz")).select("c_custkey", "from_state", "to_state")


@query("STA-07", oracle="""
    WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS a, (o_orderkey // 4) % 4 AS b, o_orderkey % 3 = 0 AS bound FROM orders) SELECT o_orderkey, b > a OR (b = a AND NOT bound) AS adopts FROM x""")
def source_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Whether an observation of another origin takes a candidate over."""
    k, kinds = F.col("o_orderkey"), F.lit(["aggregator_lead", "search_index", "official_single_record", "official_collection"])
    took = state.adopts_source(F.get(kinds, (k % 4).cast("int")), F.when(k % 3 == 0, "run"), F.get(kinds, (F.floor(k / 4) % 4).cast("int")))
    return t(spark, d, "orders").select("o_orderkey", took.alias("adopts"))


@query("SCO-03", oracle="""
    SELECT c_custkey, rank FROM (SELECT c_custkey, c_acctbal, c_custkey % 2 = 0 AS eligible, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE eligible ORDER BY rank LIMIT 10""")
def explained_first(spark: SparkSession, d: str) -> DataFrame:
    """The first ten that are eligible, by their rank among all."""
    ranked = global_rank(t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("eligible")), F.desc("c_acctbal"), F.col("c_custkey"))
    return scoring.top_for_explanation(ranked).select("c_custkey", "rank")


@query("DUP-08", oracle="""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '東京都渋谷区' ELSE '東京都渋谷区神南1,東京都' END AS addresses FROM supplier""")
def compacted_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places without those whose address only adds to another's; other cities stay."""
    place = lambda city, address: F.struct(F.lit("JP").alias("country"), F.lit("東京都").alias("prefecture"), city.alias("city"), F.lit(None).cast("string").alias("remote_scope"), F.lit(address).alias("address"))
    k, city = F.col("s_suppkey") % 2 == 0, F.lit("渋谷区")
    places = F.array(place(city, "東京都渋谷区神南1"), place(F.when(k, city), "東京都"))
    two = F.when(k, F.array(place(city, "東京都渋谷区神南1"), place(city, "東京都渋谷区"))).otherwise(places)
    return t(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(jobs.compact_locations(two), lambda x: x["address"]), ",").alias("addresses"))


@query("PAR-05", oracle="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS dates FROM orders""")
def dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Distinct dates that a text names: two of them conflict."""
    on = F.date_format("o_orderdate", "yyyy年M月d日")
    body = F.concat(F.lit("掲載 "), on, F.lit(" 更新 "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add("o_orderdate", 40), "yyyy年M月d日")).otherwise(on))
    return t(spark, d, "orders").select("o_orderkey", F.size(jobs.dates_in(body)).alias("dates"))


@query("STR-16", oracle="""
    SELECT vec_id, vec_id % 4 > 1 AS usable FROM embeddings""")
def finite_vectors(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("vec_id"), F.col("embedding")
    spoilt = F.when(k % 4 == 0, F.concat(v, F.array(F.lit(float("nan")).cast("float")))).when(k % 4 == 1, F.slice(v, 1, 0)).otherwise(v)
    return t(spark, d, "embeddings").select("vec_id", text.finite_vector(spoilt).alias("usable"))


@query("STR-09", oracle="""
    SELECT page_id, sha256(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS hash FROM pages""")
def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.sha2(text.canonical_html(F.concat(F.lit(" \r\n"), F.replace("html", F.lit("\n"), F.lit("\r\n")))), 256).alias("hash"))


@query("SNK-02", oracle="""SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """A report written as one JSON file and read again."""
    path = scratch(spark, "report")
    objects.write_report(t(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations")), path)
    return spark.read.schema("n_regionkey int, nations long").json(path)


@query("RAG-01", oracle="""
    WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS ordinal, s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 AS hit, s_acctbal AS similarity FROM supplier), h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS i FROM s WHERE hit),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY similarity DESC, ordinal) AS i FROM s WHERE doc NOT IN (SELECT doc FROM h)) SELECT doc, ordinal FROM h WHERE i <= 4 UNION ALL SELECT doc, ordinal FROM v WHERE i <= 8""")
def sections_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Sections by kind and keywords; documents of which none fits have their nearest ones."""
    k = F.col("s_suppkey")
    body = F.when((k % 3 == 0) & (F.col("s_nationkey") % 2 == 0), "we want python").otherwise("nothing")
    sections = t(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), k.alias("ordinal"), body.alias("text"), F.col("s_acctbal").alias("similarity"))
    return retrieval.rank_sections(sections, "doc", "ordinal", "text", {"skills": (F.lit(False), ["python"])}, similarity="similarity").select("doc", "ordinal")


@query("SRC-09", oracle="""
    SELECT n_nationkey, n_nationkey % 5 > 2 AS public FROM nation""")
def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Whether an address that a host resolves to may be fetched from: no loopback, private or mapped private one."""
    address = F.get(F.array(*map(F.lit, ("127.0.0.1", "10.0.0.7", "::ffff:192.168.0.1", "8.8.8.8", "2606:4700::1"))), F.col("n_nationkey") % 5)
    return t(spark, d, "nation").select("n_nationkey", urls.public_address(address).alias("public"))


@query("MRG-11", oracle="""
    SELECT p_partkey, 'kind' AS field FROM part WHERE p_size % 3 = 0""")
def facts_without_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are not unknown and have no evidence: an acceptance gate that wants none."""
    none = F.array().cast("array<string>")
    parts = t(spark, d, "part").select("p_partkey", "p_size", facts.fact(F.array("p_type")).alias("kind"), facts.fact(none).alias("size"))
    evidence = parts.where("p_size % 3 <> 0").select("p_partkey", F.lit("kind").alias("field"))
    return facts.missing_evidence(parts, "p_partkey", ["kind", "size"], evidence)


@query("AGG-06", oracle="""
    SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 IN (0, 3)""")
def not_one_target(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break the rule that exactly one of two references is set."""
    k = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select("s_suppkey", F.when(k % 4 < 2, k).alias("a"), F.when((k % 4 == 0) | (k % 4 == 2), k).alias("b"))
    return tables.violations(rows, {"one_target": tables.exactly_one("a", "b")}).select("s_suppkey")
