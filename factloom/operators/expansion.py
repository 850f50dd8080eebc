"""Growing the set of sources: merged seeds, imports of tenants, queues and reports of audits, reports of collections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import jobs
from factloom.functions.dates import lookback
from factloom.operators.ranking import global_rank, kept, top_one
from factloom.operators.tables import BucketTable, monotone_merge
from factloom.sources.crawl import robots_allow

#: Forms of tenants, of one platform and of all others; links of a company that are audited; requests that a tenant may need.
WORKDAY_TENANT, TENANT = r"(?i)^[A-Za-z0-9-]+\.wd[0-9a-z-]*\.myworkdayjobs\.com/[A-Za-z0-9._-]+$", r"^[A-Za-z0-9._-]+$"
LINKS_AUDITED, MOST_REQUESTS = 6, 120


def _first(value: str, place: str) -> Column:
    """The first value that is not null, by place."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(place)))


def merged_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds (kind, tenant, company_name, referrer_url, place) once for each tenant of a kind, whatever its case, with their rank.

    Names and referrers are the first that are there, the tenant's way of writing the last; tenants of another form than
    their platform's are left out. Ranks go by whether there is a name, then by kind and tenant. Aggregates are partial.
    """
    form = F.when(F.col("kind") == "workday", F.col("tenant").rlike(WORKDAY_TENANT)).otherwise(F.col("tenant").rlike(TENANT))
    one = seeds.where(form).groupBy("kind", F.lower("tenant").alias("_key"))
    merged = one.agg(F.max_by("tenant", "place").alias("tenant"), _first("company_name", "place").alias("company_name"), _first("referrer_url", "place").alias("referrer_url")).drop("_key")
    return global_rank(merged, F.col("company_name").isNull(), F.collate("kind", "UNICODE"), F.collate("tenant", "UNICODE"), F.col("tenant"))


#: Columns of an artifact beside its place, and how a tenant's later rows change what is stored.
ARTIFACT = "kind string, tenant string, company_name string, source_url string, locator map<string,string>, japan_signal boolean, referrer_url string, referrer_basis string"
RULES = {"tenant": "first", "company_name": "first", "source_url": "last", "locator": "map", "japan_signal": "or", "referrer_url": "first", "referrer_basis": "first"}


def _folded(artifact: DataFrame) -> DataFrame:
    """One row a tenant: what taking an artifact's rows one by one in the order of place gives."""
    key = ["kind", "tenant_key"]
    rows = artifact.withColumn("tenant_key", F.lower("tenant"))
    values = rows.groupBy(*key).agg(F.min_by("tenant", "place").alias("tenant"), _first("company_name", "place").alias("company_name"), F.max_by("source_url", "place").alias("source_url"), F.bool_or(F.coalesce("japan_signal", F.lit(False))).alias("japan_signal"),
                                    _first("referrer_url", "place").alias("referrer_url"), _first("referrer_basis", "place").alias("referrer_basis"))
    parts = rows.select(*key, "place", F.explode("locator").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "place").alias("v"))
    locators = parts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("locator"))  # as long as there are kinds of keys
    return values.join(locators, key, "left").select(*key, *RULES)


def import_tenants(store: BucketTable, artifact: DataFrame, apply: bool) -> DataFrame:
    """A report of an artifact (ARTIFACT and place) by kind, and with apply the artifact merged into the store by kind and tenant in lower case.

    would_insert and would_update count the artifact's rows by what was stored before, inserted and updated what an import
    one by one does: of several new rows of a tenant the first is inserted. Rows without a kind or a tenant are left out. The
    artifact is kept, as it is read more than once; the store reads and writes only buckets that it meets.
    """
    rows = kept(artifact.where("kind is not null and tenant is not null"))
    folded = kept(_folded(rows))
    had = store.lookup(folded)
    keys = folded.select("kind", "tenant_key")
    known = keys.withColumn("known", F.lit(False)) if had is None else keys.join(had.select("kind", "tenant_key", F.lit(True).alias("known")), ["kind", "tenant_key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    counts = rows.groupBy("kind", F.lower("tenant").alias("tenant_key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("japan_signal", F.lit(False))).alias("japan"), F.count("referrer_url").alias("referrers")).join(known, ["kind", "tenant_key"])
    fresh = F.count_if(~F.col("known"))
    report = kept(counts.groupBy("kind").agg(
        F.sum("n").alias("candidates"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("would_insert"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("would_update"),
        F.when(F.lit(apply), fresh).otherwise(0).alias("inserted"), F.when(F.lit(apply), F.sum("n") - fresh).otherwise(0).alias("updated"), F.sum("japan").alias("japan_signals"), F.sum("referrers").alias("official_referrers"),
        F.sum("n").alias("least_requests"), (F.sum("n") * MOST_REQUESTS).alias("most_requests")))
    if apply:
        store.change(folded, lambda old, new: monotone_merge(old, new, ["kind", "tenant_key"], RULES).select(*new.columns))
    return report


def audit_queue(audits: DataFrame, key: str, links: str, known_platform: Column | None = None) -> DataFrame:
    """key, url, score of the links (an array) that are worth an audit: the six best of each company, once each, none of a score of 0 or less. A company of several rows has its links together."""
    each = audits.select(key, F.explode(links).alias("url")).where(F.col("url").isNotNull()).distinct()
    scored = each.withColumn("score", jobs.link_score(F.col("url"), F.lit(False) if known_platform is None else known_platform))
    return top_one(scored.where("score > 0"), [key], F.desc("score"), "url", k=LINKS_AUDITED)


def audit_report(audited: DataFrame, key: str, sources: str) -> DataFrame:
    """kind, n, requests, companies: sources (an array of structs with a kind) found of each kind, the audits made, and companies with any source."""
    found = audited.select(key, F.explode(sources).alias("_s"))
    kinds = found.groupBy(F.col("_s")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # two single rows
    return kinds.join(F.broadcast(audited.agg(F.count(F.lit(1)).alias("requests")))).join(F.broadcast(found.agg(F.count_distinct(key).alias("companies"))))


def _allowed(robots: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([p is not None and robots_allow(r or "", p) for r, p in zip(robots, path, strict=True)], dtype=bool)


def robots_gate(pages: DataFrame, robots: str, path: str) -> DataFrame:
    """pages, if robots.txt (a column) lets all their paths be read; else an error, so that nothing is collected."""
    let = F.pandas_udf(_allowed, "boolean")(F.col(robots), F.col(path))
    return pages.withColumn("_let", let).where(F.when(F.col("_let"), True).otherwise(F.raise_error(F.concat(F.lit("robots.txt does not allow "), F.coalesce(F.col(path), F.lit("a page without a path")))).cast("boolean"))).drop("_let")


def window_report(leads: DataFrame, tenant: str, published: Column, known: Column, days: int | None, now: Column) -> DataFrame:
    """For each tenant its projects, those eligible by the window of days (all, if None), those of them that are new, and those left out by reason."""
    decision = lookback(published, days, now) if days else F.struct(F.lit(True).alias("eligible"), F.lit("").alias("reason"))
    told = leads.select(tenant, decision.alias("_d"), F.coalesce(known, F.lit(False)).alias("_known"))
    ok, unknown = F.col("_d.eligible"), F.col("_d.reason") == "publication_date_unknown"
    return told.groupBy(tenant).agg(F.count(F.lit(1)).alias("projects"), F.count_if(ok).alias("eligible"), F.count_if(ok & ~F.col("_known")).alias("inserted"), F.count_if(~ok & ~unknown).alias("outside_window"), F.count_if(unknown).alias("unknown_publication"))


def in_view(view: Column, eligible: Column, saved: Column, applied_at: Column, hidden: Column) -> Column:
    """Whether a job shows in a view: hidden ones in `hidden` alone; saved, applied, and else the eligible. States that are null are false."""
    told = lambda c: F.coalesce(c, F.lit(False))
    return F.when(view == "hidden", told(hidden)).otherwise(~told(hidden) & F.when(view == "saved", told(saved)).when(view == "applied", applied_at.isNotNull()).otherwise(told(eligible)))
