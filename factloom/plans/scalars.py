"""Queries of scalar functions: URLs, text, hashing, rule lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import jobs, text, urls
from factloom.plans.catalog import ORACLES, query
from factloom.session import table as t

_TRACKING = "'" + "', '".join(urls.TRACKING) + "'"
#: Text of parts and orders that has the words that the rules look for, alike in both engines.
_TITLE_SQL = "p_type || ' ' || CASE p_size % 8 WHEN 0 THEN 'software engineer' WHEN 1 THEN 'sales manager' WHEN 2 THEN 'recruiter' WHEN 3 THEN '営業事務' WHEN 4 THEN 'data scientist' WHEN 5 THEN 'chef' WHEN 6 THEN '介護職' ELSE 'general position' END"


def part_title() -> Column:
    words = ["software engineer", "sales manager", "recruiter", "営業事務", "data scientist", "chef", "介護職", "general position"]
    return F.concat_ws(" ", "p_type", F.get(F.array(*map(F.lit, words)), F.col("p_size") % 8))


@query("STR-01", oracle=f"""
    WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS h, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT lower(split_part(x, '=', 1)) IN ({_TRACKING}))) AS kept FROM p)
    SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url FROM q""")
def url_normalised(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", urls.normalise_plain_url(F.col("url")).alias("url"))


@query("STR-01", oracle=ORACLES["url_normalised"])
def url_normalised_any(spark: SparkSession, d: str) -> DataFrame:
    """The form for any URL; equal to the one above where that applies."""
    return t(spark, d, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url"))


@query("SRC-18", "SRC-09", oracle="""
    WITH x AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, starts_with(url, 'https://') AS safe FROM pages),
    y AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'hrmos.co' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'boards.greenhouse.io' ELSE host END AS h2, '/' || CASE page_id % 4 WHEN 0 THEN 'pages/t' || page_id || '/jobs/7' WHEN 1 THEN 't' || page_id WHEN 2 THEN 't' || page_id || '/jobs' ELSE 'x' END AS p2 FROM x)
    SELECT page_id, host, safe, CASE page_id % 4 WHEN 0 THEN 'hrmos' WHEN 1 THEN 'lever' WHEN 2 THEN 'greenhouse' END AS kind, CASE WHEN page_id % 4 < 3 THEN 't' || page_id END AS tenant,
        CASE page_id % 4 WHEN 0 THEN 'https://hrmos.co/pages/t' || page_id || '/jobs' WHEN 1 THEN 'https://jobs.lever.co/t' || page_id WHEN 2 THEN 'https://boards-api.greenhouse.io/v1/boards/t' || page_id || '/jobs' END AS source_url FROM y""")
def detect_source(spark: SparkSession, d: str) -> DataFrame:
    k, tenant = F.col("page_id"), F.concat(F.lit("t"), F.col("page_id").cast("string"))
    made = F.when(k % 4 == 0, F.concat(F.lit("https://hrmos.co/pages/"), tenant, F.lit("/jobs/7"))).when(k % 4 == 1, F.concat(F.lit("https://jobs.lever.co/"), tenant)).when(k % 4 == 2, F.concat(F.lit("https://boards.greenhouse.io/"), tenant, F.lit("/jobs"))).otherwise(F.col("url"))
    s = urls.detect_source(made)
    return t(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.is_safe_url(F.col("url")).alias("safe"), s["kind"].alias("kind"), s["tenant"].alias("tenant"), s["url"].alias("source_url"))


@query("STR-02", "STR-03", "STR-04", "DUP-03", oracle=r"""
    WITH x AS (SELECT p_partkey, p_name || ' Co., Ltd.' AS company, p_type AS title, p_brand AS place FROM part),
    y AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(company), '株式会社|有限会社|合同会社|inc\.?|ltd\.?|corp\.?', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS company_name, regexp_replace(lower(company), '\s+', '', 'g') AS directory_name, regexp_replace(lower(company), '[^0-9a-z]', '', 'g') AS ascii_name,
        trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS weak_title, trim(regexp_replace(lower(place), '[^\p{L}\p{N}]+', ' ', 'g')) AS weak_place FROM x)
    SELECT p_partkey, company_name, directory_name, ascii_name, weak_title, sha256(company_name || chr(0) || weak_title || chr(0) || weak_place) AS cluster FROM y""")
def weak_cluster(spark: SparkSession, d: str) -> DataFrame:
    """ASCII names need no composition, so all is built-in functions."""
    name = F.concat(F.col("p_name"), F.lit(" Co., Ltd."))
    return t(spark, d, "part").select(
        "p_partkey", text.company_name(name, False).alias("company_name"), text.directory_name(name, False).alias("directory_name"), text.ascii_name(name).alias("ascii_name"), text.weak_text(F.col("p_type"), False).alias("weak_title"),
        text.weak_cluster_key(name, F.col("p_type"), F.col("p_brand"), False).alias("cluster"))


@query("DUP-02", "STR-08", oracle="""
    SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN 'official:' || url WHEN page_id % 3 = 1 THEN 'external:fam:t' || (page_id % 10) || ':' || page_id ELSE 'detail:' || url END) AS identity, sha256(html) AS raw_hash, sha256(encode('v1') || '\\x00'::BLOB || encode(html)) AS content_hash FROM pages""")
def identity_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    key = text.strong_key(F.lit("fam"), F.when(k % 3 == 1, F.concat(F.lit("t"), (k % 10).cast("string"))), k.cast("string"), F.col("url"), F.when(k % 3 == 0, F.col("url")))
    return t(spark, d, "pages").select("page_id", F.sha2(key, 256).alias("identity"), text.raw_hash(F.encode("html", "UTF-8")).alias("raw_hash"), text.content_hash(F.lit("v1"), F.col("html")).alias("content_hash"))


@query("STR-12", "STR-13", "STR-14", "STR-15", oracle="""
    SELECT doc_id, substr(trim(text), 1, 40) AS quote, contains(lower(text), 'the of') AS folded, replace(replace(replace(replace(replace(substr(trim(text), 1, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, trim(list_last(string_split(source || ' / ' || lang, '/'))) AS company FROM documents""")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.concise_quote(body, 40).alias("quote"), text.includes_folded(body, F.lit("THE OF")).alias("folded"), text.escape_html(text.concise_quote(body, 60)).alias("escaped"), text.company_from_title(F.concat_ws(" / ", "source", "lang")).alias("company"))


@query("STR-05", oracle=r"""
    WITH x AS (SELECT doc_id, replace(text, ' ', chr(160) || '  ') || chr(13) || chr(10) || chr(10) || chr(10) || ' end  ' AS raw FROM documents)
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(raw, chr(160), ' '), '[ \t\f\v]+', ' ', 'g'), ' *\r?\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9))) AS cleaned FROM x""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("   ")), F.lit("\r\n\n\n end  "))
    return t(spark, d, "documents").select("doc_id", F.sha2(text.clean_text(raw), 256).alias("cleaned"))


@query("STR-07", "STR-10", "STR-11", "STR-17", "SCO-02", oracle="""
    WITH k AS (SELECT o_custkey, sha256('{"version":"v1","inputs":[' || string_agg('{"id":' || o_orderkey || ',"score":' || o_totalprice || '}', ',' ORDER BY o_orderkey) || ']}') AS run_key FROM orders GROUP BY o_custkey)
    SELECT o_custkey, run_key, sha256('{"kind":"enrich","parts":{"job":' || o_custkey || ',"model":"m"}}') AS task_key, '{"title":"t","company":"c","description":"' || run_key || '"}' AS input FROM k""")
def stable_keys(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    keyed = orders.groupBy("o_custkey").agg(text.run_key(F.lit("v1"), F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))).alias("run_key"))
    return keyed.withColumn("task_key", text.idempotency_key(F.lit("enrich"), job=F.col("o_custkey"), model=F.lit("m"))).withColumn("input", text.embedding_text(F.lit("t"), F.lit("c"), F.col("run_key")))


@query("CLS-04", "CLS-06", oracle=f"""
    WITH x AS (SELECT p_partkey, {_TITLE_SQL} AS s FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(s, '(?i)software|engineer|developer|product|web|AI|machine learning|data|e.?commerce|IT|システム|エンジニア|開発|プロダクト') THEN 'p0' WHEN regexp_matches(s, '(?i)consult|human resources|recruit|talent acquisition|people operations|人事|採用|コンサル') THEN 'p1' WHEN regexp_matches(s, '(?i)介護|特定技能|specified skilled worker') THEN 'p3' ELSE 'p2' END AS priority,
        CASE WHEN regexp_matches(s, '(?i)software|engineer|developer|product|web|AI|machine learning|data|e.?commerce|IT|システム|エンジニア|開発|プロダクト') THEN 'IT・Web・AI・EC' WHEN regexp_matches(s, '(?i)consult|human resources|recruit|talent|人事|採用|コンサル') THEN 'ITコンサル・HR・人事' WHEN regexp_matches(s, '(?i)介護|看護|福祉|care|nurs') THEN '介護・医療' ELSE 'その他' END AS industry FROM x""")
def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", part_title().alias("s")).select("p_partkey", jobs.priority(F.col("s")).alias("priority"), jobs.industry(F.col("s")).alias("industry"))


@query("CLS-01", "CLS-02", "CLS-07", "PRO-13", oracle="""
    WITH x AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '東京都渋谷区' WHEN 1 THEN 'Singapore' WHEN 2 THEN 'London, UK / Japan' WHEN 3 THEN '' WHEN 4 THEN '大阪市' ELSE 'Seoul' END AS a FROM supplier)
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'japan' WHEN 1 THEN 'non_japan' WHEN 2 THEN 'japan' WHEN 3 THEN 'unknown' WHEN 4 THEN 'japan' ELSE 'non_japan' END AS state, CASE s_suppkey % 6 WHEN 0 THEN 'JP' WHEN 1 THEN 'SG' WHEN 2 THEN 'JP' WHEN 4 THEN 'JP' WHEN 5 THEN 'KR' END AS country, CASE s_suppkey % 6 WHEN 0 THEN '東京都' ELSE '日本・都道府県未分類' END AS bucket FROM x""")
def japan_locations(spark: SparkSession, d: str) -> DataFrame:
    places = ["東京都渋谷区", "Singapore", "London, UK / Japan", "", "大阪市", "Seoul"]
    a = F.get(F.array(*map(F.lit, places)), (F.col("s_suppkey") % 6).cast("int"))
    return t(spark, d, "supplier").select("s_suppkey", a.alias("a")).select("s_suppkey", jobs.japan_location(F.col("a")).alias("state"), jobs.country_code(F.col("a")).alias("country"), jobs.place_bucket(F.col("a")).alias("bucket"))


@query("CLS-11", "PRO-01", oracle="""
    WITH x AS (SELECT p_partkey, [200, 403, 404, 410, 429, 500, 503, 418][p_partkey % 8 + 1] AS s FROM part)
    SELECT p_partkey, CASE WHEN s = 403 THEN 'forbidden' WHEN s IN (404, 410) THEN 'record_closed' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'upstream_error' WHEN s >= 400 THEN 'schema_changed' END AS code, CASE WHEN s >= 400 THEN s = 429 OR s >= 500 END AS retryable,
        CASE WHEN p_partkey % 7 = 0 THEN 'promoted_active' WHEN s <> 200 AND s < 500 THEN 'unreachable' WHEN p_partkey % 5 = 0 THEN 'insecure_source' WHEN p_partkey % 3 = 0 THEN 'unsupported_source' WHEN p_partkey % 2 = 0 THEN 'unstructured_career_page' ELSE 'verified_no_current_job' END AS status FROM x""")
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = F.get(F.array(*map(F.lit, [200, 403, 404, 410, 429, 500, 503, 418])), (k % 8).cast("int"))
    one = lambda n: (k % n == 0).cast("int")
    status = jobs.company_status(one(7), (F.col("s") == 200) | (F.col("s") >= 500), k % 5 != 0, one(3), one(2))
    return t(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", jobs.http_error(F.col("s")).alias("e"), status.alias("status")).select("p_partkey", "e.code", "e.retryable", "status")


@query("PRO-05", "SRT-08", oracle=r"""
    WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS href FROM pages), u AS (SELECT page_id, 'https://example.com/jobs' || href AS url FROM l),
    s AS (SELECT page_id, url, 100 + CASE WHEN regexp_matches(lower(url), 'career|recruit|採用|求人|募集') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'guideline|requirement|recruitment|detail|information') THEN 25 ELSE 0 END
        - CASE WHEN regexp_matches(lower(url), 'contact|entry|interview|message|about|welfare|faq|voice|member|data|environment|privacy|news|blog|twitter|facebook') THEN 60 ELSE 0 END - CASE WHEN regexp_matches(url, '\.(pdf|jpg|jpeg|png)$') THEN 100 ELSE 0 END AS score FROM u)
    SELECT page_id, url, score::INTEGER AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) <= 6""")
def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.ranking import top_one

    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1))
    links = t(spark, d, "pages").select("page_id", F.explode(hrefs).alias("href")).select("page_id", F.concat(F.lit("https://example.com/jobs"), "href").alias("url"))
    scored = links.withColumn("score", jobs.link_score(F.col("url"), F.lit(False))).where("score > 0")
    return top_one(scored, ["page_id"], F.desc("score"), "url", k=6)


@query("CLS-09", "CLS-10", "MRG-05", oracle="""
    WITH x AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 300 WHEN 'click' THEN 200 ELSE 100 END AS p FROM events)
    SELECT user_id, arg_max(event_id, (p, -epoch_us(ts), -event_id)) AS primary_event, max(p) AS priority FROM x GROUP BY user_id""")
def primary_source(spark: SparkSession, d: str) -> DataFrame:
    """A source takes over only with a strictly greater priority, so the first of the greatest stays."""
    kind = F.when(F.col("event_type") == "purchase", "greenhouse").when(F.col("event_type") == "click", "hrmos").otherwise("other")
    x = t(spark, d, "events").select("event_id", "user_id", "ts", jobs.source_priority(kind).alias("p"))
    return x.groupBy("user_id").agg(F.max_by("event_id", F.struct("p", -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id"))).alias("primary_event"), F.max("p").alias("priority"))


@query("SRC-20", "PRO-07", "PRO-09", oracle="""
    SELECT s_suppkey, 'lever' AS kind, 't' || s_suppkey AS tenant FROM supplier UNION ALL SELECT s_suppkey, 'ashby', 'a' || (s_suppkey % 5) FROM supplier""")
def tenants_in_text(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.crawl import tenants_in_text as find

    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("see https:\\/\\/jobs.lever.co\\/t"), k, F.lit(", also https://jobs.ashbyhq.com/a"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/x and https://jobs.ashbyhq.com/a"), (F.col("s_suppkey") % 5).cast("string"), F.lit("."))
    return t(spark, d, "supplier").select("s_suppkey", F.explode(find(body)).alias("x")).select("s_suppkey", "x.kind", "x.tenant").distinct()


@query("NUM-01", "NUM-03", "NUM-04", "SET-02", oracle="""
    SELECT o_orderkey, greatest(0, least(25, floor(25 * (o_orderkey % 7) / 6 + 0.5)))::INTEGER AS score, round((o_orderkey % 7) / 6, 6) AS share FROM orders""")
def number_rules(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("o_orderkey") % 7
    return t(spark, d, "orders").select("o_orderkey", F.greatest(F.lit(0), F.least(F.lit(25), F.floor(25 * part / 6 + 0.5))).cast("int").alias("score"), F.round(part / 6, 6).alias("share"))


