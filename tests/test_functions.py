"""Literal cases of scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, jobs, occupations, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Example.com:443/jobs/1/?utm_source=x&b=2&a=1#top", "https://example.com/jobs/1?a=1&b=2"),
        ("https://example.com/?REF=1", "https://example.com/"), ("http://example.com:8080/a//", "http://example.com:8080/a"), ("nonsense", None), (None, None),
        ("https://example.com/a?q=a b&q=%E6%97%A5", "https://example.com/a?q=a+b&q=%E6%97%A5"),
    ],
)
def test_normal_url(raw, want):
    assert urls.normalise(raw) == want


@pytest.mark.parametrize(
    ("url", "kind", "tenant"),
    [
        ("https://hrmos.co/pages/acme/jobs/1", "hrmos", "acme"), ("https://boards.greenhouse.io/acme/jobs/12", "greenhouse", "acme"), ("https://boards-api.greenhouse.io/v1/boards/acme/jobs", "greenhouse", "acme"),
        ("https://open.talentio.com/r/1/c/acme/homes/33", "talentio", "acme"), ("https://acme.wd3.myworkdayjobs.com/en-US/careers/job/Tokyo/x_1", "workday", "acme.wd3.myworkdayjobs.com/careers"),
        ("https://acme.wd3.myworkdayjobs.com/en-US/careers", "workday", "acme.wd3.myworkdayjobs.com/careers"), ("https://x.jbplt.jp/a", "jobposting", "x"), ("https://public.n-ats.hrmos.co/a/jobs/b", "schema_org", "n-ats:a:b"), ("https://example.com/jobs", None, None),
    ],
)
def test_detect_source(spark, url, kind, tenant):
    got = one(spark, urls.detect_source(F.col("u")), u=url)
    assert (got.kind, got.tenant) == (kind, tenant) if kind else got is None


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("10.1.2.3", False), ("127.0.0.1", False), ("::1", False), ("::ffff:192.168.0.1", False), ("2606:4700::1111", True), ("x", False)])
def test_public_address(address, public):
    assert urls.is_public_address(address) is public


@pytest.mark.parametrize(
    ("raw", "value", "precision"),
    [
        ("掲載日：2026年7月1日", "2026-07-01", "date"), ("datePosted: 2026-7-1", "2026-07-01", "date"), ("2026-02-30", None, None), ("2026-07-15T10:00:00+09:00", "2026-07-15T01:00:00.000Z", "datetime"),
        ("2026-07-15T10:00:00", "2026-07-15T10:00:00.000Z", "datetime"), ("soon", None, None), ("", None, None),
    ],
)
def test_published_date(spark, raw, value, precision):
    got = one(spark, dates.parse_published(F.col("t")), t=raw)
    assert (got and got.value, got and got.precision) == (value, precision)


def test_months_end_at_the_last_day(spark):
    assert one(spark, dates.shift_months(F.lit("2026-08-31").cast("date"), -6)) == dt.date(2026, 2, 28)


@pytest.mark.parametrize(
    ("published", "seen", "state", "reason"),
    [
        ("2026-01-15", "2026-07-01", "recent", "published_within_retention_window"), ("2026-01-14", "2026-07-01", "expired", "published_older_than_retention_window"), ("2026-07-16", "2026-07-01", "expired", "published_in_future"),
        (None, "2026-07-10", "unknown_quarantine", "publication_date_unknown"), (None, "2026-07-08", "expired", "publication_date_unknown_after_grace"),
    ],
)
def test_freshness(spark, published, seen, state, reason):
    got = one(spark, dates.freshness(F.lit(published).cast("date"), F.lit(seen).cast("timestamp"), F.lit("2026-07-15 00:00:00").cast("timestamp")))
    assert (got.freshness, got.reason) == (state, reason)


@pytest.mark.parametrize(
    ("raw", "period", "low", "high"),
    [
        ("年収 400万円〜600万円", "year", 4_000_000, 6_000_000), ("月給22万円～25万円", "month", 220_000, 250_000), ("月給 ¥220,000 - ¥250,000", "month", 220_000, 250_000), ("基本給 21万5000円", "month", 215_000, 215_000),
        ("時給1200円", "hour", 1200, 1200), ("¥300K - ¥400K / Month", "month", 300_000, 400_000), ("年収 600万円〜400万円", None, None, None), ("応相談", None, None, None),
    ],
)
def test_compensation(spark, raw, period, low, high):
    got = one(spark, jobs.compensation(F.col("t")), t=raw)
    assert [(p.period, int(p.minimum), int(p.maximum)) for p in got] == ([(period, low, high)] if period else [])


@pytest.mark.parametrize(
    ("raw", "country", "prefecture", "city", "remote"),
    [("東京都渋谷区神南", "JP", "東京都", "渋谷区", None), ("Tokyo, Japan", "JP", "東京都", None, None), ("フルリモート", None, None, None, "japan"), ("fully remote worldwide, Berlin", "DE", None, None, "unspecified"), ("大阪府 大阪市", "JP", "大阪府", "大阪市", None)],
)
def test_location(spark, raw, country, prefecture, city, remote):
    got = one(spark, jobs.location(F.col("t")), t=raw)
    assert (got.country, got.prefecture, got.city, got.remote_scope) == (country, prefecture, city, remote)


def test_location_of_no_place(spark):
    assert one(spark, jobs.location(F.col("t")), t="応相談") is None
    assert one(spark, jobs.location(F.col("t")), t="  ") is None


@pytest.mark.parametrize(("raw", "want"), [("", "unknown"), ("Singapore", "non_japan"), ("Japan or Singapore", "japan"), ("大阪市", "japan"), ("UK", "non_japan"), ("Mars", "unknown")])
def test_japan(spark, raw, want):
    assert one(spark, jobs.japan_location(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("no visa sponsorship", "conflicting"), ("visa support available", "known"), ("ビザ支援なし", "conflicting"), ("", "unknown")])
def test_visa(spark, raw, want):
    assert one(spark, jobs.visa_support(F.col("t")), t=raw).state == want


@pytest.mark.parametrize(
    ("title", "description", "family", "role", "confidence"),
    [
        ("営業事務", None, "office_administration", "sales_office_assistant", "high"), ("iOSエンジニア", None, "it_web_software", "mobile_app_engineer", "high"), ("営業", None, "sales_customer_success", "general_sales", "high"),
        ("総合職", "介護職の募集です", "welfare_care", "care_worker", "medium"), ("総合職", "介護職と看護師", "other", "other_unclassified", "low"), ("", None, "other", "other_unclassified", "low"),
    ],
)
def test_occupation(spark, title, description, family, role, confidence):
    df = spark.createDataFrame([(title, description)], "t string, d string")
    got = df.select(occupations.classify(F.col("t"), F.col("d")).alias("o")).first().o
    assert (got.family, got.role, got.confidence) == (family, role, confidence)


def test_secondary_families_and_tags(spark):
    df = spark.createDataFrame([("人事 / マーケティング / 経理 / iOS", "英語")], "t string, d string")
    got = df.select(occupations.classify(F.col("t"), F.col("d")).alias("o")).first().o
    assert [x.family for x in got.secondary] == ["it_web_software", "planning_marketing_management"] and got.tags == ["iOS", "英語"]


def test_names_compose(spark):
    assert one(spark, text.company_name(F.col("t")), t="株式会社 ＡＢＣ Inc.") == "abc"
    a, b = (one(spark, text.weak_cluster_key(F.lit(c), F.lit(t_), F.lit("東京"))) for c, t_ in (("株式会社ＡＢＣ", "Web エンジニア"), ("abc", "web　エンジニア")))
    assert a == b


def test_word_bounds_beside_japanese(spark):
    assert one(spark, F.col("t").rlike(text.js(r"\bAI\b")), t="日AI本") and not one(spark, F.col("t").rlike(text.js(r"\bAI\b")), t="MAIL")


def test_strongest_requirement(spark):
    both = F.concat(jobs.skills(F.lit("Python"), F.lit("mentioned")), jobs.skills(F.lit("Java Python"), F.lit("required")))
    assert [(x.skill, x.requirement) for x in one(spark, jobs.strongest(both, "skill"))] == [("python", "required"), ("java", "required")]


def test_stable_hashes(spark):
    a, b = (one(spark, text.run_key(F.lit("v"), F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("score")) for i, s in x]))) for x in ([(1, 5), (2, 3)], [(2, 3), (1, 5)]))
    assert a == b
