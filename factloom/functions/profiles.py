"""Safe profiles: what a résumé shows of a list of allowed skills and signals, beside a stated policy, and nothing else of it."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.jobs import no_direct_pii
from factloom.functions.text import JS_SPACE, matches
from factloom.sources import html

#: Skills that count where they stand as words of their own.
SKILLS = (
    "TypeScript", "JavaScript", "React", "Next.js", "Node.js", "NestJS", "Python", "Java", "Go", "C#", "PostgreSQL", "SQL", "Supabase", "AWS", "GCP", "Docker", "Kubernetes", "Cloudflare", "GitHub Actions",
    "AI", "LLM", "OpenAI", "iOS", "Swift", "SwiftUI", "Unity", "WebGL", "Three.js",
)
#: Patterns of four capabilities, which are skills and signals alike, and of the other signals.
OFFICE, ACADEMIC = r"事務員|事務職|一般事務|総合科|office administration|administrative", r"教務担当|教務|学校事務|大学事務|academic affairs|student affairs"
RESEARCH, CULTURES = r"聞き取り調査|生活史調査|質的調査|文献調査|interview research", r"多文化共生|異文化|文化や前提の違い|中国語・日本語・英語|cross-cultural"
CAPABILITIES = (("Office Administration", OFFICE), ("Academic Affairs", ACADEMIC), ("Qualitative Research", RESEARCH), ("Cross-cultural Communication", CULTURES))
SIGNALS = (
    ("web_product", r"Web|フロントエンド|バックエンド|プロダクト"), ("ai_engineering", r"(?<![A-Za-z0-9])(?:AI|LLM)(?![A-Za-z0-9])|機械学習|生成AI"), ("ios_engineering", r"iOS|Swift|SwiftUI"), ("unity_game", r"Unity|ゲーム|WebGL"),
    ("office_administration", OFFICE), ("academic_affairs", ACADEMIC), ("qualitative_research", RESEARCH), ("cross_cultural_communication", CULTURES),
)
UNSEEN = frozenset(("script", "style", "noscript"))


def _body_text(pages: pd.Series) -> pd.Series:
    def text(markup: str) -> str:
        root = html.parse(markup)
        root.prune(UNSEEN)
        return (root.first("body") or root).text()

    return pages.map(lambda x: None if x is None else text(x))


def body_text(page: Column) -> Column:
    """The text of a page's body without scripts and styles, white space as single spaces; null for null."""
    return F.regexp_replace(F.pandas_udf(_body_text, "string")(page), f"[{JS_SPACE}]+", " ")


def _parts(pattern: str) -> list[str]:
    """Texts in lower case of which a match of the pattern holds one: what stands between its bars, without look-arounds and escapes."""
    plain = re.sub(r"\\(.)", r"\1", re.sub(r"\(\?<?![^)]*\)|\(\?:|\)", "", pattern))
    return [x.lower() for x in plain.split("|")]


def _listed(text: Column, rules: tuple[tuple[str, str], ...], lower: Column | None = None) -> Column:
    """Names of the rules that match. A pattern is slow beside a plain search, so it is tried only where one of its parts stands in the text in lower case."""
    lower = F.lower(text) if lower is None else lower

    def told(pattern: str) -> Column:
        found = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in _parts(pattern)])
        return F.when(F.coalesce(found, F.lit(False)), matches(text, pattern))

    return F.array_compact(F.array(*[F.when(told(p), name) for name, p in rules]))


def skills(text: Column, lower: Column | None = None) -> Column:
    """Allowed skills in a text, in the order of the list. lower: the text in lower case, if it is at hand."""
    return _listed(text, tuple((s, rf"(?<![A-Za-z0-9]){re.escape(s)}(?![A-Za-z0-9])") for s in SKILLS) + CAPABILITIES, lower)


def signals(text: Column, lower: Column | None = None) -> Column:
    return _listed(text, SIGNALS, lower)


def safe_profiles(df: DataFrame, text: str, policy: str) -> DataFrame:
    """df with profile and refused in place of the text: profile is the policy's struct with skills, signals and pii_policy.

    A policy that holds a mail address, a phone number, a postal code or a URL is refused: its profile is null, so that one
    such row does not end the job. A null or empty text has no skills and no signals. Columns named profile or refused are replaced.
    """
    names = [c for c in df.columns if c not in (text, "profile", "refused")]
    told = df.withColumn("_lower", F.lower(text)).withColumns({"_skills": skills(F.col(text), F.col("_lower")), "_signals": signals(F.col(text), F.col("_lower"))})
    own = [F.col(f"{policy}.{c}").alias(c) for c in df.select(f"{policy}.*").columns if c not in ("skills", "signals", "pii_policy")]
    rule = F.struct(F.lit(False).alias("direct_pii_stored"), F.lit("allowlist_only").alias("extraction_mode"))
    profile = F.struct(*own, F.col("_skills").alias("skills"), F.col("_signals").alias("signals"), rule.alias("pii_policy"))
    refused = ~no_direct_pii(F.to_json(profile))
    made = told.withColumns({"_profile": profile, "_refused": refused})
    return made.select(*names, F.when(~F.col("_refused"), F.col("_profile")).alias("profile"), F.col("_refused").alias("refused"))
