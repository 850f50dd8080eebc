"""Queries of the domain: facts from texts, merging, occupations, scoring, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates, jobs, occupations
from factloom.operators import facts, scoring
from factloom.operators.ranking import global_rank
from factloom.plans.catalog import query
from factloom.plans.scalars import part_title
from factloom.session import spread
from factloom.session import table as t

_FAMILY = "CASE p_size % 8 WHEN 0 THEN 'it_web_software' WHEN 1 THEN 'sales_customer_success' WHEN 2 THEN 'corporate_management' WHEN 3 THEN 'office_administration' WHEN 4 THEN 'it_web_software' WHEN 5 THEN 'retail_service_hospitality' WHEN 6 THEN 'welfare_care' ELSE 'other' END"
_ROLE = "CASE p_size % 8 WHEN 0 THEN 'general_software_engineer' WHEN 1 THEN 'sales_management' WHEN 2 THEN 'human_resources_recruiting' WHEN 3 THEN 'sales_office_assistant' WHEN 4 THEN 'data_ai_ml_engineer' WHEN 5 THEN 'food_service' WHEN 6 THEN 'care_worker' ELSE 'other_unclassified' END"


@query("CLS-05", "CLS-10", oracle=f"""
    SELECT p_partkey, {_FAMILY} AS family, {_ROLE} AS role, CASE WHEN p_size % 8 = 7 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN p_size % 8 IN (0, 4) THEN 1.0 WHEN p_size % 8 = 1 THEN 0.4 ELSE 0.0 END::DOUBLE AS weight FROM part""")
def occupations_of_titles(spark: SparkSession, d: str) -> DataFrame:
    classed = scoring.with_occupation(spread(t(spark, d, "part").select("p_partkey", "p_type", "p_size")), part_title(), F.lit(None).cast("string"), "o")
    return classed.select("p_partkey", "o.family", "o.role", "o.confidence", occupations.role_weight(F.col("o"), {"product_web_ai_engineering": 1.0, "sales_management": 0.4}).alias("weight"))


@query("AGG-14", "CLS-05", oracle=f"""
    WITH f AS (SELECT unnest(['{"', '".join(occupations.FAMILIES)}']) AS family), c AS (SELECT {_FAMILY} AS family, count(*) AS n FROM part GROUP BY 1) SELECT family, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (family)""")
def occupation_facets(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.combine import facet_counts

    known = spark.createDataFrame([(x,) for x in occupations.FAMILIES], "family string")
    classed = scoring.with_occupation(t(spark, d, "part"), part_title(), F.lit(None).cast("string"), "o")
    return facet_counts(classed, "p_partkey", occupations.all_families(F.col("o")), known)


@query("PAR-07", "NUM-01", "NUM-02", oracle="""
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'hour' WHEN 3 THEN 'month' END AS period,
        CASE o_orderkey % 5 WHEN 0 THEN (300 + o_orderkey % 100) * 10000 WHEN 1 THEN 220000 + o_orderkey % 1000 WHEN 2 THEN 1200 WHEN 3 THEN (20 + o_orderkey % 9) * 10000 + 5000 END::DECIMAL(16,2) AS minimum,
        CASE o_orderkey % 5 WHEN 0 THEN (400 + o_orderkey % 100) * 10000 WHEN 1 THEN 250000 + o_orderkey % 1000 WHEN 2 THEN 1200 WHEN 3 THEN (20 + o_orderkey % 9) * 10000 + 5000 END::DECIMAL(16,2) AS maximum,
        CASE o_orderkey % 5 WHEN 0 THEN (400 + o_orderkey % 100) * 10000 WHEN 1 THEN (250000 + o_orderkey % 1000) * 12 WHEN 2 THEN 0 WHEN 3 THEN ((20 + o_orderkey % 9) * 10000 + 5000) * 12 ELSE 0 END::DOUBLE AS annual FROM orders""")
def salary_ranges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("想定年収 "), s(300 + k % 100), F.lit("万円〜"), s(400 + k % 100), F.lit("万円"))).when(k % 5 == 1, F.concat(F.lit("月給 ¥"), s(220000 + k % 1000), F.lit(" - "), s(250000 + k % 1000), F.lit("円")))
        .when(k % 5 == 2, F.lit("時給 1200円")).when(k % 5 == 3, F.concat(F.lit("基本給："), s(20 + k % 9), F.lit("万5000円"))).otherwise("経験による")
    )
    pay = t(spark, d, "orders").select("o_orderkey", F.get(jobs.compensation(text), 0).alias("p"))
    return pay.select("o_orderkey", "p.period", "p.minimum", "p.maximum", F.coalesce(jobs.annual_maximum(F.col("p")), F.lit(0)).cast("double").alias("annual"))


@query("CLS-03", "PAR-02", "PAR-03", "PAR-04", "PAR-08", "PAR-09", "DUP-09", oracle="""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'permanent' WHEN 1 THEN 'fixed_term,part_time' WHEN 2 THEN 'part_time' ELSE '' END AS employment, CASE WHEN c_custkey % 3 = 0 THEN 'python:required,ai:required' WHEN c_custkey % 3 = 1 THEN 'java:required,aws:preferred' ELSE '' END AS skills,
        CASE c_custkey % 3 WHEN 0 THEN 'ja:N2' WHEN 1 THEN 'en:800' ELSE '' END AS languages, CASE WHEN c_custkey % 30 BETWEEN 1 AND 30 THEN (c_custkey % 30)::VARCHAR ELSE '' END AS years, CASE c_custkey % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'conflicting' ELSE 'unknown' END AS visa FROM customer""")
def facts_in_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    employment = F.when(k % 4 == 0, "正社員").when(k % 4 == 1, "契約社員 / part-time").when(k % 4 == 2, "PART_TIME").otherwise("パートナー募集")
    need = F.when(k % 3 == 0, "Pythonと日本AIの経験。JLPT N2 以上").when(k % 3 == 1, "Java, TOEIC 800").otherwise("コミュニケーション")
    more = F.when(k % 3 == 1, "AWS or Java").otherwise("")
    visa = F.when(k % 3 == 0, "visa sponsorship available").when(k % 3 == 1, "no visa sponsorship").otherwise("")
    years = F.concat(F.lit("実務経験"), (k % 30).cast("string"), F.lit("年以上"))
    s = jobs.strongest(F.concat(jobs.skills(more, F.lit("preferred")), jobs.skills(need, F.lit("required"))), "skill")
    ordered = F.array_sort(s, lambda a, b: F.when(a["requirement"] > b["requirement"], -1).when(a["requirement"] < b["requirement"], 1).otherwise(0))
    joined = lambda xs, f: F.array_join(F.transform(xs, f), ",")
    return t(spark, d, "customer").select(
        "c_custkey", F.array_join(jobs.employment_types(employment), ",").alias("employment"), joined(ordered, lambda x: F.concat_ws(":", x["skill"], x["requirement"])).alias("skills"),
        joined(jobs.languages(need, F.lit("required")), lambda x: F.concat_ws(":", x["language"], x["level"])).alias("languages"), joined(jobs.experience_years(years), lambda y: y.cast("string")).alias("years"), jobs.visa_support(visa)["state"].alias("visa"))


@query("PAR-06", oracle="""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'JP' WHEN 1 THEN 'JP' WHEN 2 THEN 'SG' END AS country, CASE s_suppkey % 4 WHEN 0 THEN '東京都' WHEN 1 THEN '大阪府' END AS prefecture, CASE s_suppkey % 4 WHEN 0 THEN '渋谷区' END AS city, CASE s_suppkey % 4 WHEN 1 THEN 'japan' WHEN 2 THEN 'unspecified' END AS remote FROM supplier""")
def locations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    a = F.when(k % 4 == 0, "東京都渋谷区 神南1-2").when(k % 4 == 1, "Osaka (fully remote)").when(k % 4 == 2, "Singapore or fully remote worldwide").otherwise("未定")
    return t(spark, d, "supplier").select("s_suppkey", jobs.location(a).alias("l")).select("s_suppkey", "l.country", "l.prefecture", "l.city", F.col("l.remote_scope").alias("remote"))


@query("DAT-04", oracle="""
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT10:30:00.000Z') END AS value, CASE WHEN o_orderkey % 5 < 2 THEN 'date' WHEN o_orderkey % 5 = 2 THEN 'datetime' END AS precision FROM orders""")
def published_dates(spark: SparkSession, d: str) -> DataFrame:
    k, on = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("datePosted: "), F.date_format(on, "yyyy/M/d"))).when(k % 5 == 1, F.concat(F.lit("掲載日："), F.date_format(on, "yyyy年M月d日")))
        .when(k % 5 == 2, F.date_format(on, "yyyy-MM-dd'T'10:30:00'Z'")).when(k % 5 == 3, F.date_format(on, "yyyy-'13'-dd")).otherwise("soon")
    )
    p = dates.parse_published(raw)
    return t(spark, d, "orders").select("o_orderkey", p["value"].alias("value"), p["precision"].alias("precision"))


def _line_facts(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order as its sources: the first is primary; each tells its flag, or nothing."""
    c = F.col
    text = lambda cond, v: facts.fact(F.when(cond, F.array(v)).otherwise(F.array().cast("array<string>")), F.when(c("l_suppkey") % 2 == 0, "not_parsed").otherwise("not_mentioned"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.when(c("l_quantity") > 25, "primary").otherwise("supporting").alias("role"), text(c("l_quantity") > 10, c("l_returnflag")).alias("flag"), text(c("l_discount") > 0.04, c("l_linestatus")).alias("status"))


@query("MRG-01", "MRG-02", "MRG-03", "DUP-04", oracle="""
    WITH x AS (SELECT l_orderkey, CASE WHEN l_quantity > 10 THEN l_returnflag END AS f, CASE WHEN l_discount > 0.04 THEN l_linestatus END AS s, CASE WHEN l_suppkey % 2 = 0 THEN 'not_parsed' ELSE 'not_mentioned' END AS why FROM lineitem),
    y AS (SELECT l_orderkey, list_sort(list_distinct(list(f) FILTER (f IS NOT NULL))) AS fs, count(DISTINCT f) AS nf, list_sort(list_distinct(list(s) FILTER (s IS NOT NULL))) AS ss, count(DISTINCT s) AS ns, CASE WHEN bool_or(why = 'not_parsed') THEN 'not_parsed' ELSE 'not_mentioned' END AS why FROM x GROUP BY l_orderkey),
    z AS (SELECT l_orderkey, CASE WHEN nf = 0 THEN 'unknown' WHEN nf > 1 THEN 'conflicting' ELSE 'known' END AS flag_state, coalesce(array_to_string(fs, ','), '') AS flags, CASE WHEN nf = 0 THEN why END AS flag_reason, CASE WHEN ns = 0 THEN 'unknown' ELSE 'known' END AS status_state, coalesce(array_to_string(ss, ','), '') AS statuses FROM y)
    SELECT *, CASE WHEN flag_state = 'known' AND status_state = 'known' THEN 'ready' WHEN flag_state = 'conflicting' THEN 'needs_review' ELSE 'pending_enrichment' END AS readiness FROM z""")
def fact_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = facts.merge_sources(_line_facts(spark, d), "l_orderkey", "role", "l_suppkey", exclusive=[], single=["flag"], plain=["status"])
    values = lambda f: F.array_join(F.array_sort(F.col(f)["values"]), ",")
    ready = facts.readiness(F.col("flag"), F.col("status"), F.lit("deterministic"), True)
    return merged.select("l_orderkey", F.col("flag.state").alias("flag_state"), values("flag").alias("flags"), F.col("flag.unknown_reason").alias("flag_reason"), F.col("status.state").alias("status_state"), values("status").alias("statuses"), ready["state"].alias("readiness"))


@query("PRJ-02", "MRG-09", "RAG-05", oracle="""
    WITH x AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_quantity > 10 THEN l_returnflag END) AS nf, count(DISTINCT CASE WHEN l_discount > 0.04 THEN l_linestatus END) AS ns FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, 'flag' AS field, CASE WHEN nf = 0 THEN 'known' WHEN nf > 1 THEN 'conflicting' ELSE 'known' END AS state, nf = 0 AS filled FROM x UNION ALL SELECT l_orderkey, 'status', CASE WHEN ns = 0 THEN 'unknown' ELSE 'known' END, false FROM x""")
def field_states(spark: SparkSession, d: str) -> DataFrame:
    """States by field after unknown flags are filled by what a later step found."""
    merged = facts.merge_sources(_line_facts(spark, d), "l_orderkey", "role", "l_suppkey", exclusive=[], single=["flag"], plain=["status"])
    filled = merged.withColumn("was", F.col("flag.state") == "unknown").withColumn("flag", facts.fill_unknown(F.col("flag"), F.array(F.lit("A"))))
    states = facts.field_states(filled, "l_orderkey", ["flag", "status"], F.lit("ready"))
    return states.join(filled.select("l_orderkey", "was"), "l_orderkey").select("l_orderkey", "field", "state", (F.col("was") & (F.col("field") == "flag")).alias("filled"))


@query("MRG-08", oracle="""
    SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'active' ELSE 'closed' END AS state, arg_min(o_orderkey, (o_orderstatus <> 'F', o_orderdate, o_orderkey)) AS primary_source FROM orders GROUP BY o_custkey""")
def canonical_state(spark: SparkSession, d: str) -> DataFrame:
    """Active with any active source; a lost primary is repaired by the oldest supporting source."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.bool_or(F.col("o_orderstatus") == "O"), "active").otherwise("closed").alias("state"), F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "F", "o_orderdate", "o_orderkey")).alias("primary_source"))


@query("JOI-12", oracle="""
    WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_nationkey || ':' || (s_suppkey % 7) AS a, (s_acctbal / 500)::INT || ':' || (s_suppkey % 3) AS b FROM supplier), e AS (SELECT DISTINCT x.id AS i, y.id AS j FROM n x JOIN n y ON x.a = y.a OR x.b = y.b),
    r AS (SELECT id, id AS root FROM n UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id) SELECT id AS s_suppkey, min(root) AS entity FROM r GROUP BY id""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Records that share a URL or a company's posting id are one entity, named by its smallest id; also through others."""
    from factloom.operators.entities import resolve

    n = t(spark, d, "supplier").select("s_suppkey", F.concat_ws(":", "s_nationkey", (F.col("s_suppkey") % 7)).alias("a"), F.concat_ws(":", F.round(F.col("s_acctbal") / 500).cast("int"), (F.col("s_suppkey") % 3)).alias("b"))
    return resolve(n, "s_suppkey", ["a", "b"]).select("s_suppkey", "entity")


def job_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers as jobs: facts from their numbers, titles from their segments."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    place = F.when(k % 3 == 0, "東京都港区").when(k % 3 == 1, "Singapore").otherwise("大阪府大阪市")
    skills = F.filter(F.array(F.struct(F.lit("python").alias("skill"), F.lit("Python").alias("original"), F.lit("required").alias("requirement")), F.struct(F.lit("java").alias("skill"), F.lit("Java").alias("original"), F.lit("preferred").alias("requirement"))), lambda x: (x["skill"] == "python") | (F.col("c_custkey") % 2 == 0))
    spoken = F.array(F.struct(F.lit("ja").alias("language"), F.lit("N2").alias("level"), F.lit("required").alias("requirement")))
    pay = F.array(F.struct(F.lit("total").alias("kind"), F.lit("JPY").alias("currency"), F.lit("year").alias("period"), F.lit(3_000_000).cast("decimal(16,2)").alias("minimum"), (3_500_000 + (k % 10) * 100_000).cast("decimal(16,2)").alias("maximum"), F.lit(False).alias("calculated")))
    years = F.when(k % 11 == 0, F.array(F.struct(F.lit(5).alias("years"), F.lit("required").alias("requirement")))).otherwise(F.array().cast("array<struct<years:int,requirement:string>>"))
    return spread(t(spark, d, "customer").select("c_custkey")).select(
        k, F.concat(F.when(k % 5 == 0, "新卒 ").otherwise(""), F.when(k % 2 == 0, "software engineer").otherwise("営業事務")).alias("title"), F.lit(None).cast("string").alias("description"), F.when(k % 13 == 0, "closed").otherwise("active").alias("lifecycle_state"), (k % 4 != 0).alias("verified"),
        F.when(k % 7 == 0, F.lit("2024-01-30 12:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp").alias("fetched_at"), facts.fact(F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.lit("dispatch"))).otherwise(F.array(F.lit("permanent"))), "not_mentioned").alias("employment"),
        facts.fact(F.array(jobs.location(place))).alias("locations"), facts.fact(skills).alias("skills"), facts.fact(spoken).alias("languages"), jobs.visa_support(F.lit("")).alias("visa"), facts.fact(pay).alias("compensation"), facts.fact(years).alias("experience"))


def profile() -> scoring.Profile:
    return scoring.Profile(preferred=["permanent"], needs_confirmation=["fixed_term"], excluded=["dispatch"], languages=["ja", "en"], skills=["Python"], annual_target=4_000_000)


def _now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query("SCO-01", "SCO-02", "DAT-11", "NUM-02", "SRT-04", oracle="""
    WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 25 ELSE 0 END AS role_direction, CASE WHEN c_custkey % 2 = 0 THEN 13 ELSE 25 END AS skills, 15 AS language, CASE WHEN c_custkey % 5 = 0 THEN 10 WHEN c_custkey % 11 = 0 THEN 1 ELSE 3 END AS recruitment_channel,
        CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END AS location_remote, CASE WHEN c_custkey % 6 > 1 THEN 5 ELSE 0 END AS employment, CASE WHEN c_custkey % 10 >= 5 THEN 5 ELSE 2 END AS compensation, CASE WHEN c_custkey % 4 <> 0 THEN 3 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS freshness_source FROM customer),
    y AS (SELECT k, (role_direction + skills + language + recruitment_channel + location_remote + employment + compensation + freshness_source)::INTEGER AS score, k % 13 <> 0 AND k % 4 <> 0 AND k % 6 > 1 AND k % 3 = 0 AS eligible,
        array_to_string(list_filter([CASE WHEN k % 13 = 0 THEN 'job_not_active' END, CASE WHEN k % 4 = 0 THEN 'no_verified_official_source' END, CASE WHEN k % 6 = 0 THEN 'employment_unresolved' END, CASE WHEN k % 6 = 1 THEN 'explicitly_excluded_employment' END, CASE WHEN k % 3 <> 0 THEN 'explicit_location_conflict' END], lambda v: v IS NOT NULL), ',') AS hard_rejects FROM x)
    SELECT k AS c_custkey, score, eligible, hard_rejects, row_number() OVER (ORDER BY score DESC, k) AS rank FROM y""")
def score_rank(spark: SparkSession, d: str) -> DataFrame:
    table = scoring.with_occupation(job_table(spark, d), F.col("title"), F.col("description"))
    weight = occupations.role_weight(F.col("occupation"), {"product_web_ai_engineering": 1.0})
    scored = scoring.evaluate(table, profile(), _now(), weight)
    return global_rank(scored.select("c_custkey", "score", "eligible", F.array_join("hard_rejects", ",").alias("hard_rejects")), F.desc("score"), F.col("c_custkey"))


@query("SCO-04", oracle="""
    WITH b AS (SELECT p_partkey, p_size < 10 AS was, p_size < 12 AS now, p_type AS a, CASE WHEN p_size = 11 THEN upper(p_type) ELSE p_type END AS z FROM part)
    SELECT p_partkey, NOT was AND now AS admitted FROM b WHERE was IS DISTINCT FROM now OR a IS DISTINCT FROM z""")
def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a new parser version changes, by a null-safe comparison of whole rows."""
    part = t(spark, d, "part")
    before, after = part.select("p_partkey", (F.col("p_size") < 10).alias("was"), F.struct("p_type").alias("a")), part.select("p_partkey", (F.col("p_size") < 12).alias("now"), F.struct(F.when(F.col("p_size") == 11, F.upper("p_type")).otherwise(F.col("p_type")).alias("p_type")).alias("z"))
    both = before.join(after, "p_partkey", "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")) | ~F.col("a").eqNullSafe(F.col("z"))).select("p_partkey", (~F.col("was") & F.col("now")).alias("admitted"))


@query("PAR-10", "PAR-11", oracle="""
    SELECT doc_id, NOT regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}') AND NOT regexp_matches(text, '(\\+?81[-\\s]?)?0\\d{1,4}[-\\s]\\d{1,4}[-\\s]\\d{3,4}') AND NOT regexp_matches(text, '〒?\\d{3}-\\d{4}') AND NOT regexp_matches(text, 'https?://') AS safe FROM documents""".replace("\\\\", "\\"))
def profile_safety(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", jobs.no_direct_pii(F.col("text")).alias("safe"))


