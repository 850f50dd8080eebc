"""Queries of safe profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import profiles
from factloom.plans.catalog import query
from factloom.session import spread
from factloom.session import table as t

_WORD = lambda s: "regexp_matches(x, '(?i)(^|[^A-Za-z0-9])" + s.replace(".", "\\.").replace("+", "\\+") + "($|[^A-Za-z0-9])')"
_LISTED = lambda rules: "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules) + ")"
_ANY = lambda pattern: f"regexp_matches(x, '(?i)({pattern})')"
_SKILLS = [*((s, _WORD(s)) for s in profiles.SKILLS), *((n, _ANY(p)) for n, p in profiles.CAPABILITIES)]
_SIGNALS = [(n, _ANY(p) if n != "ai_engineering" else "(" + " OR ".join((_WORD("AI"), _WORD("LLM"), _ANY("機械学習|生成AI"))) + ")") for n, p in profiles.SIGNALS]


@query("PAR-11", oracle=f"""
    WITH r AS (SELECT doc_id, lang, source, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' TypeScript,React 生成AI' WHEN 1 THEN ' C# JavaScripts 事務職' WHEN 2 THEN ' Next.js/GitHub Actions Cross-Cultural' WHEN 3 THEN ' GoAI 文献調査' WHEN 4 THEN ' swiftui' ELSE '' END AS x FROM documents)
    SELECT doc_id, doc_id % 7 < 2 AS refused, CASE WHEN doc_id % 7 > 1 THEN lang END AS channel, CASE WHEN doc_id % 7 > 1 THEN {_LISTED(_SKILLS)} END AS skills, CASE WHEN doc_id % 7 > 1 THEN {_LISTED(_SIGNALS)} END AS signals FROM r""")
def safe_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of résumés made from documents as pages, with a script that must not count; every seventh policy has a mail address, every next a phone number."""
    k = F.col("doc_id")
    extra = F.get(F.array(*[F.lit(x) for x in (" TypeScript,React 生成AI", " C# JavaScripts 事務職", " Next.js/GitHub Actions Cross-Cultural", " GoAI 文献調査", " swiftui", "")]), (k % 6).cast("int"))
    shown = F.concat(F.coalesce("text", F.lit("")), extra)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = F.replace(shown, F.lit(plain), F.lit(escaped))
    page = F.concat(F.lit("<html><head><title>Kubernetes</title><style>.unity{}</style></head><body><script>var Python = 1</script><p>"), shown, F.lit("</p><noscript>Docker</noscript></body></html>"))
    contact = F.when(k % 7 == 0, "me@mail.example").when(k % 7 == 1, "03-1234-5678").otherwise("none")
    policy = F.struct("lang", F.array(contact).alias("locations"))
    made = spread(t(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", page.alias("page"), policy.alias("policy"))
    told = profiles.safe_profiles(made.withColumn("page", profiles.body_text(F.col("page"))), "page", "policy")
    return told.select("doc_id", "refused", F.col("profile.lang").alias("channel"), *[F.array_join(f"profile.{c}", ",").alias(c) for c in ("skills", "signals")])
