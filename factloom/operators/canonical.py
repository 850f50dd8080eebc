"""Canonical records over source records: assignment, taking apart, versions by content, review tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.combine import looked_up
from factloom.operators.entities import resolve
from factloom.operators.ranking import kept

#: How a record found its canonical one, strongest first.
RULES = ("existing_source", "official_link", "application_url", "posting_id")


def assign(records: DataFrame, links: DataFrame, official: DataFrame) -> DataFrame:
    """record_id, canonical_id, merged_by for each row of records (record_id, url, company, posting; nulls match nothing).

    links: record_id, canonical_id, url, company, posting, active_from, active_to. official: record_id, canonical_id.
    A record keeps its open link; else takes an official one, else the oldest open link of its URL, else that of its
    company's posting. What is left is new: records of the batch that share a URL or a posting are one entity, named by
    its smallest id, whose first record is `new`. Taken one by one, in their order of arrival, records find the same
    where none of them joins two others; `assign_in_order` gives that result in any case.
    """
    open_ = links.where("active_to is null")
    oldest = lambda *keys: open_.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by("canonical_id", F.struct("active_from", "record_id")).alias("canonical_id"))
    sides = (oldest("record_id"), official.select("record_id", "canonical_id"), oldest("url"), oldest("company", "posting"))
    keys = (["record_id"], ["record_id"], ["url"], ["company", "posting"])
    found = [records.join(side, on).select("record_id", "canonical_id", F.lit(i).alias("rule")) for i, (side, on) in enumerate(zip(sides, keys, strict=True))]
    every = found[0].union(found[1]).union(found[2]).union(found[3])
    best = every.groupBy("record_id").agg(F.min_by("canonical_id", "rule").alias("canonical_id"), F.min("rule").alias("rule"))
    matched = best.select("record_id", F.col("canonical_id").cast("string").alias("canonical_id"), F.get(F.lit(list(RULES)), F.col("rule")).alias("merged_by"))
    left = records.join(best, "record_id", "left_anti").withColumn("_job", F.concat_ws(":", "company", F.when(F.col("company").isNotNull(), F.col("posting").cast("string"))))
    left = left.withColumn("_job", F.when(F.col("company").isNotNull() & F.col("posting").isNotNull(), F.col("_job")))
    grouped = resolve(left, "record_id", ["url", "_job"])
    first = left.where("url is not null").groupBy("url").agg(F.min("record_id").alias("_first"))
    rule = F.when(F.col("record_id") == F.col("entity"), "new").when(F.col("_first") < F.col("record_id"), "application_url").otherwise("posting_id")
    new = looked_up(grouped, first, ["url"]).select("record_id", F.concat(F.lit("new-"), F.col("entity").cast("string")).alias("canonical_id"), rule.alias("merged_by"))
    return matched.unionByName(new)


def assign_in_order(records: DataFrame, links: DataFrame, official: DataFrame, arrival: str = "record_id") -> DataFrame:
    """record_id, canonical_id, merged_by: what taking the records one by one in the order of arrival (then record_id) gives.

    Tables as in `assign`. A record that has no open link and no official one looks for the oldest open link of its URL,
    then of its company's posting; links of earlier batches are older than any of this one. So, where an earlier batch
    has none, a record follows the first record of its URL in this batch, else the first earlier one of its posting: each has one
    record before it that it follows, or none, and the canonical record of that chain's end. Chains are shortened by pointer jumping. A record
    that follows one component is never merged with another that it would join. A record with an open link adds none: its link is found by the keys in links. Keys of many records are broadcast, null keys match nothing.
    """
    open_ = links.where("active_to is null")
    oldest = lambda name, *keys: open_.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by(F.col("canonical_id").cast("string"), F.struct("active_from", "record_id")).alias(name))
    batch = records.select("record_id", "url", "company", "posting", F.struct(F.col(arrival).alias("at"), F.col("record_id").alias("id")).alias("turn"))
    own = kept(batch.join(oldest("_had", "record_id"), "record_id", "left").join(official.select("record_id", F.col("canonical_id").cast("string").alias("_official")), "record_id", "left"))
    first = lambda name, *keys: own.where("_had is null").dropna(subset=list(keys)).groupBy(*keys).agg(F.min("turn").alias(name))
    by_url = looked_up(own, oldest("_url", "url").join(first("_first_url", "url"), "url", "full"), ["url"])
    posting = ["company", "posting"]
    found = looked_up(by_url, oldest("_posting", *posting).join(first("_first_posting", *posting), posting, "full"), posting)
    earlier = lambda c: F.coalesce(F.col(c) < F.col("turn"), F.lit(False))
    way = F.when(F.col("_had").isNotNull(), 0).when(F.col("_official").isNotNull(), 1).when(F.col("_url").isNotNull() | earlier("_first_url"), 2).when(F.col("_posting").isNotNull() | earlier("_first_posting"), 3)
    fixed = F.coalesce("_had", "_official", "_url", F.when(~earlier("_first_url"), F.col("_posting")))
    follows = F.when(fixed.isNull(), F.when(earlier("_first_url"), F.col("_first_url.id")).when(earlier("_first_posting"), F.col("_first_posting.id")))
    chain = kept(found.select("record_id", fixed.alias("end"), follows.alias("up"), way.alias("way")))
    while chain.where("up is not null").limit(1).count():
        beyond = chain.select(F.col("record_id").alias("up"), F.coalesce("end", F.when(F.col("up").isNull(), F.concat(F.lit("new-"), F.col("record_id").cast("string")))).alias("_end"), F.col("up").alias("_up"))
        done, open_chain = chain.where("up is null"), chain.where("up is not null")
        chain = kept(done.unionByName(looked_up(open_chain, beyond, ["up"]).select("record_id", F.col("_end").alias("end"), F.col("_up").alias("up"), "way")))
    named = F.coalesce("end", F.concat(F.lit("new-"), F.col("record_id").cast("string")))
    return chain.select("record_id", named.alias("canonical_id"), F.coalesce(F.get(F.lit(list(RULES)), F.col("way")), F.lit("new")).alias("merged_by"))


def unmerge(links: DataFrame, apart: DataFrame, now: Column) -> DataFrame:
    """links (record_id, canonical_id, role, rule, active_from, active_to) after records leave for new canonical records.

    apart: record_id, new_canonical. The open link of each is closed and a primary one of its own opened. A canonical
    record that lost its primary gets its oldest other open link as one: that link is closed and opened anew.
    """
    a_moment_on = F.greatest(now, F.col("active_from") + F.expr("interval 1 microsecond"))
    leaving = links.where("active_to is null").join(apart, "record_id")
    bereft = leaving.where("role = 'primary'").select("canonical_id").distinct()
    staying = links.where("active_to is null").join(apart, "record_id", "left_anti").join(bereft, "canonical_id", "left_semi")
    heirs = staying.groupBy("canonical_id").agg(F.min_by("record_id", F.struct("active_from", "record_id")).alias("record_id"))
    closing = leaving.select("record_id", "canonical_id").union(heirs.select("record_id", "canonical_id")).withColumn("_closes", F.lit(True))
    kept = links.join(closing, ["record_id", "canonical_id"], "left").withColumn("active_to", F.when(F.col("_closes") & F.col("active_to").isNull(), a_moment_on).otherwise(F.col("active_to"))).select(*links.columns)
    never = F.lit(None).cast(links.schema["active_to"].dataType)
    opened = lambda df, canonical, rule: df.select("record_id", F.col(canonical).alias("canonical_id"), F.lit("primary").alias("role"), F.lit(rule).alias("rule"), now.alias("active_from"), never.alias("active_to"))
    return kept.unionByName(opened(leaving, "new_canonical", "manual_unmerge")).unionByName(opened(heirs, "canonical_id", "unmerge_primary_repair"))


def new_versions(versions: DataFrame, current: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """Rows of current whose content hash their key does not have yet, with content_hash; equal content counts once.

    versions: key, content_hash. Only a hash that is new makes a version, also where content returns to an older state.
    """
    hashed = current.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"}), 256))
    return hashed.dropDuplicates([key, "content_hash"]).join(versions.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def review_tasks(facts: DataFrame, key: str, fields: Sequence[str], known: DataFrame, source: str = "deterministic_readiness") -> DataFrame:
    """key, field, reason and idempotency_key of a task for each fact that is not known and has none in `known` (idempotency_key)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["state"].alias("state"), F.coalesce(F.col(f)["unknown_reason"], F.lit("low_confidence")).alias("reason")) for f in fields]))
    tasks = facts.select(key, each.alias("x")).where("x.state <> 'known'").select(key, "x.field", "x.reason")
    body = F.to_json(F.struct(F.col(key).cast("string").alias("extractionId"), "field", "reason", F.lit(source).alias("source")))
    return tasks.withColumn("idempotency_key", F.sha2(body, 256)).join(known.select("idempotency_key"), "idempotency_key", "left_anti")
