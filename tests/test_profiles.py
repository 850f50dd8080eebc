"""Safe profiles: allowed skills and signals of a page, policies with personal data refused."""

import re

from pyspark.sql import functions as F

from factloom.functions import profiles

PAGE = "<html><head><title>Docker</title></head><body><script>Python</script><style>.x{}</style><noscript>Java</noscript><h1>React\n developer</h1><p>JavaScripted, C#, GitHub　Actions; 一般事務 and LLMs</p></body></html>"


def test_body_text(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("no markup",)], "page string")
    texts = [r[0] for r in df.select(profiles.body_text(F.col("page"))).collect()]
    assert texts[1:] == [None, "", "no markup"] and "Python" not in texts[0] and "Docker" not in texts[0] and "GitHub Actions" in texts[0]


def test_skills_and_signals(spark):
    df = spark.createDataFrame([("React, c#; GitHub Actions, LLM. JavaScripted 一般事務",), ("nothing",), ("",), (None,)], "t string")
    got = df.select(profiles.skills(F.col("t")).alias("s"), profiles.signals(F.col("t")).alias("g")).collect()
    assert got[0].s == ["React", "C#", "GitHub Actions", "LLM", "Office Administration"] and got[0].g == ["ai_engineering", "office_administration"]
    assert [tuple(r) for r in got[1:]] == [([], [])] * 3


def test_refused_policies(spark):
    policies = [("Tokyo", False), ("a@b.example", True), ("+81 03-1234-5678", True), ("〒150-0001", True), ("http://x", True), (None, False)]
    df = spark.createDataFrame([(i, "Go", "own", (p, ["ja"])) for i, (p, _) in enumerate(policies)], "id int, text string, profile string, policy struct<place: string, languages: array<string>>")
    got = profiles.safe_profiles(df, "text", "policy").orderBy("id").collect()
    assert [r.refused for r in got] == [bad for _, bad in policies] and all((r.profile is None) == r.refused for r in got)
    assert got[0].profile.asDict(True) == {"place": "Tokyo", "languages": ["ja"], "skills": ["Go"], "signals": [], "pii_policy": {"direct_pii_stored": False, "extraction_mode": "allowlist_only"}}
    assert profiles.safe_profiles(df.where("false"), "text", "policy").count() == 0


def test_patterns_are_tried_where_their_words_stand(spark):
    """What a plain search leaves is what the patterns alone find, and the plan has that search."""
    texts = ["GoAI reacts, SWIFTUI", "next.js Node.JS c# c#x", "Kelvin sKills gitHub actions", "İOS ios", "生成AI 機械学習", "CROSS-CULTURAL webgl", None, ""]
    df = spark.createDataFrame([(i, t, ("x",)) for i, t in enumerate(texts)], "id int, t string, policy struct<p: string>")
    rules = tuple((s, rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])") for s in profiles.SKILLS) + profiles.CAPABILITIES
    plain = lambda rules: F.array_compact(F.array(*[F.when(profiles.matches(F.col("t"), p), n) for n, p in rules]))
    assert df.where(profiles.skills(F.col("t")) != plain(rules)).count() == df.where(profiles.signals(F.col("t")) != plain(profiles.SIGNALS)).count() == 0
    told = profiles.safe_profiles(df, "t", "policy").select("id", "refused", "profile.skills", "profile.signals")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan
