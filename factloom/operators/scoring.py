"""The deterministic, explainable score of a job for a profile: eight dimensions that add up to 100, and hard rejects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import occupations
from factloom.functions.dates import freshness_score
from factloom.functions.jobs import annual_maximum, title_employment
from factloom.functions.text import matches
from factloom.operators.ranking import kept
from factloom.session import spread

#: Dimensions in order, and the most of each.
DIMENSIONS = {"role_direction": 25, "skills": 25, "language": 15, "recruitment_channel": 10, "location_remote": 10, "employment": 5, "compensation": 5, "freshness_source": 5}
NEARBY, NEAR_TOKYO = "Tokyo|東京|神奈川|千葉|埼玉", "神奈川|千葉|埼玉"
GRADUATES, BEGINNERS = r"27卒|2027.{0,4}卒|新卒|第二新卒|junior|entry.?level", r"経験.{0,8}[012]年|未経験|ポテンシャル"


@dataclass
class Profile:
    preferred: list[str] = field(default_factory=list)
    needs_confirmation: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    annual_target: int = 4_000_000


def _among(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _share(most: int, hits: Column, of: Column) -> Column:
    """most times hits of so many, halves up."""
    return F.floor(most * hits / of + 0.5).cast("int")


def evaluate(jobs: DataFrame, profile: Profile, now: Column, role_weight: Column) -> DataFrame:
    """jobs with eligible, hard_rejects, scores (a struct), score, and which fields matched, fall short or are unknown.

    jobs: lifecycle_state, verified, title, description, fetched_at, and facts employment (strings), locations,
    skills, languages, visa (booleans), compensation and experience (struct(years, requirement)).
    role_weight: 0 to 1, as the profile's priorities weigh the job's occupation.
    """
    c, told = F.col, lambda f: F.col(f)["state"] != "unknown"
    employment = F.array_union(c("employment")["values"], title_employment(c("title")))
    unknown_employment = ~told("employment") & (F.size(employment) == 0)
    preferred, confirm, excluded = (F.arrays_overlap(employment, _among(v)) for v in (profile.preferred, profile.needs_confirmation, profile.excluded))
    places = c("locations")["values"]
    accepted = F.exists(places, lambda v: (F.coalesce(v["remote_scope"], F.lit("")) == "japan") | (F.coalesce(v["prefecture"], F.lit("")) == "東京都") | matches(v["address"], NEARBY))
    abroad = lambda v: F.coalesce(v["country"] != "JP", F.lit(False))
    elsewhere = lambda v: F.coalesce((v["country"] == "JP") & v["remote_scope"].isNull() & v["prefecture"].isNotNull() & (v["prefecture"] != "東京都"), F.lit(False)) & ~matches(v["address"], NEAR_TOKYO)
    conflict = (F.size(places) > 0) & F.forall(places, lambda v: abroad(v) | elsewhere(v))
    skills = c("skills")["values"]
    hits = F.size(F.filter(skills, lambda s: F.array_contains(_among([x.lower() for x in profile.skills]), s["skill"])))
    required = F.filter(c("languages")["values"], lambda x: x["requirement"] == "required")
    covered = F.size(F.filter(required, lambda x: F.array_contains(_among(profile.languages), x["language"])))
    enough = F.exists(c("compensation")["values"], lambda p: annual_maximum(p) >= profile.annual_target)
    text = F.concat_ws("\n", "title", F.coalesce("description", F.lit("")))
    channel = F.when(matches(text, GRADUATES), 10).when(matches(text, BEGINNERS), 8).otherwise(3)
    senior = F.exists(c("experience")["values"], lambda e: (e["requirement"] == "required") & (F.coalesce(e["years"], F.lit(0)) >= 3))
    scores = {
        "role_direction": F.floor(25 * role_weight + 0.5).cast("int"),
        "skills": F.when(~told("skills") | (F.size(skills) == 0), 0).otherwise(_share(25, hits, F.size(skills))),
        "language": F.when(~told("languages"), 0).when(F.size(required) == 0, 10).otherwise(_share(15, covered, F.size(required))),
        "recruitment_channel": F.when(senior & (channel < 10), 1).otherwise(channel),
        "location_remote": F.when(told("locations") & accepted, 10).otherwise(0),
        "employment": F.when(unknown_employment, 0).when(preferred, 5).when(confirm, 3).otherwise(0),
        "compensation": F.when(~told("compensation"), 0).when(enough, 5).otherwise(2),
        "freshness_source": F.when(c("verified"), 3).otherwise(0) + freshness_score(c("fetched_at"), now),
    }
    capped = {k: F.greatest(F.lit(0), F.least(F.lit(m), scores[k])).cast("int") for k, m in DIMENSIONS.items()}
    rejects = F.array_compact(F.array(
        F.when(c("lifecycle_state") != "active", "job_not_active"), F.when(~c("verified"), "no_verified_official_source"), F.when(c("employment")["state"] != "known", "employment_unresolved"),
        F.when(~unknown_employment & excluded, "explicitly_excluded_employment"), F.when(c("locations")["state"] != "known", "location_unresolved"), F.when(told("locations") & ~accepted & conflict, "explicit_location_conflict")))
    unknowns = F.array_compact(F.array(
        F.when(unknown_employment | (~unknown_employment & confirm), "employment"), F.when(~told("locations") | (~accepted & ~conflict), "locations"), *[F.when(~told(f), f) for f in ("skills", "languages", "visa", "compensation")]))
    matched = F.array_compact(F.array(
        F.when(~unknown_employment & preferred, "employment"), F.when(told("locations") & accepted, "locations"), F.when(hits > 0, "skills"), F.when(F.exists(c("languages")["values"], lambda x: F.array_contains(_among(profile.languages), x["language"])), "languages"),
        F.when((c("visa")["state"] == "known") & F.array_contains(c("visa")["values"], True), "visa"), F.when(told("compensation"), "compensation"), F.when(scores["role_direction"] > 0, "role_direction")))
    missing_skill = F.exists(skills, lambda s: (s["requirement"] == "required") & ~F.array_contains(_among([x.lower() for x in profile.skills]), s["skill"]))
    gaps = F.array_compact(F.array(
        F.when(~unknown_employment & excluded, "employment"), F.when(told("locations") & ~accepted & conflict, "locations"), F.when(missing_skill, "skills"), F.when(covered < F.size(required), "languages"),
        F.when((c("visa")["state"] == "conflicting") | ((c("visa")["state"] == "known") & ~F.array_contains(c("visa")["values"], True)), "visa"), F.when(scores["role_direction"] == 0, "role_direction"), F.when(senior, "experience")))
    out = jobs.withColumns({"scores": F.struct(*[v.alias(k) for k, v in capped.items()]), "hard_rejects": rejects, "matched": matched, "gaps": gaps, "unknowns": unknowns})
    total = sum((F.col("scores")[k] for k in DIMENSIONS), F.lit(0))
    return out.withColumn("score", total).withColumn("eligible", F.size("hard_rejects") == 0)


def top_for_explanation(ranked: DataFrame, most: int = 10) -> DataFrame:
    return ranked.where("eligible").orderBy("rank").limit(most)


#: Distinct titles up to which their occupations are sent to every task.
FEW_TITLES = 50_000


def with_occupation(jobs: DataFrame, title: Column, description: Column, name: str = "occupation") -> DataFrame:
    """jobs with the occupation of each, which is worked out once for each distinct title and beginning of a description.

    Titles repeat much, and their patterns cost more than a join. Up to FEW_TITLES distinct ones are broadcast; more
    come by a shuffle, in which Spark splits a title of very many jobs.
    """
    keyed = jobs.withColumns({"_title": F.coalesce(title, F.lit("")), "_text": F.substring(F.coalesce(description, F.lit("")), 1, 600), "_tags": occupations.specialties(title, description)})
    each = kept(spread(keyed.select("_title", "_text", "_tags").distinct()).withColumn(name, occupations.classify(F.col("_title"), F.col("_text"), F.col("_tags"))))
    few = each.limit(FEW_TITLES + 1).count() <= FEW_TITLES
    return keyed.join(F.broadcast(each) if few else each, ["_title", "_text", "_tags"]).drop("_title", "_text", "_tags")


def of_family(jobs: DataFrame, family: str, name: str = "occupation") -> DataFrame:
    """The jobs whose occupation is of a family, as its first or as a further one."""
    return jobs.where(F.array_contains(occupations.all_families(F.col(name)), family))
