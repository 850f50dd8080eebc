"""State as functions: new state from old state and events. Each works on whole tables, keyed and without row locks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dates import retry_seconds

#: How strong a lead's origin is.
ORIGINS = {"official_collection": 4, "official_single_record": 3, "search_index": 2, "aggregator_lead": 1}


@dataclass
class Breaker:
    """When too much is missing to believe that it closed."""

    minimum_previous: int = 5
    ratio: float = 0.5
    absolute: int = 25


def breaker_reasons(previous: Column, current: Column, missing: Column, policy: Breaker) -> Column:
    share = F.when(previous == 0, 0.0).otherwise(missing / previous)
    reasons = F.array_compact(F.array(
        F.when((previous >= policy.minimum_previous) & (current == 0), "unexpected_zero"), F.when(share > policy.ratio, "missing_ratio_exceeded"), F.when(missing > policy.absolute, "missing_absolute_exceeded")))
    return F.when(missing == 0, F.array().cast("array<string>")).otherwise(reasons)


def finalise_snapshots(pages: DataFrame, allowed: DataFrame, previous: DataFrame, policy: Breaker = Breaker()) -> DataFrame:  # noqa: B008
    """One row a run from its pages' rows: is the snapshot authoritative or partial, and why.

    pages: source_id, run_id, page_no, is_last_page, next_cursor, provider_total, row_source_id, stable_key (null on an
    empty page), error. allowed: source_id, allows. previous: source_id, stable_key of what was active.
    """
    own = F.when(F.col("row_source_id") == F.col("source_id"), F.col("stable_key"))
    keys = pages.select("source_id", "run_id", own.alias("stable_key")).where("stable_key is not null").distinct()
    per_run = pages.groupBy("source_id", "run_id").agg(
        F.count_distinct("page_no").alias("pages"), F.max("provider_total").alias("provider_total"), F.min("provider_total").alias("_least"),
        F.bool_or("is_last_page").alias("completed"), F.bool_or(~F.col("is_last_page") & F.col("next_cursor").isNull()).alias("_no_cursor"),
        F.bool_or(F.col("stable_key").isNotNull() & (F.col("row_source_id") != F.col("source_id"))).alias("_foreign"), F.bool_or(F.col("error").isNotNull()).alias("_error"))
    counts = keys.groupBy("source_id", "run_id").agg(F.count(F.lit(1)).alias("jobs"))
    seen = previous.join(keys, ["source_id", "stable_key"]).groupBy("source_id", "run_id").agg(F.count(F.lit(1)).alias("_still"))
    before = previous.groupBy("source_id").agg(F.count(F.lit(1)).alias("previous"))
    out = per_run.join(counts, ["source_id", "run_id"], "left").join(seen, ["source_id", "run_id"], "left").join(before, "source_id", "left").join(allowed, "source_id", "left")
    out = out.fillna(0, ["jobs", "_still", "previous"]).withColumn("missing", F.col("previous") - F.col("_still"))
    errors = F.array_compact(F.array(F.when(F.col("_error"), "page_failed"), F.when(F.col("_no_cursor"), "non_final_page_without_cursor"), F.when(F.col("_least") != F.col("provider_total"), "provider_total_changed")))
    out = out.withColumns({"parse_errors": errors, "total_matched": F.col("provider_total").isNull() | (F.col("provider_total") == F.col("jobs")), "tenant_consistent": ~F.coalesce("_foreign", F.lit(False)), "breaker": breaker_reasons(F.col("previous"), F.col("jobs"), F.col("missing"), policy)})
    good = F.coalesce("allows", F.lit(False)) & F.col("completed") & (F.size("parse_errors") == 0) & F.col("tenant_consistent") & F.col("total_matched") & (F.size("breaker") == 0)
    return out.withColumn("kind", F.when(good, "authoritative").otherwise("partial")).drop("_least", "_no_cursor", "_foreign", "_error", "_still", "allows")


def absence_step(state: Column, count: Column, counted_at: Column, present: Column, at: Column, required: int, interval: Column) -> Column:
    """struct(state, count, counted_at) after one authoritative snapshot. A closing needs `required` absences, each an interval after the one before."""
    due = counted_at.isNull() | (at >= counted_at + interval)
    missed = F.struct(F.when(count + 1 >= required, "closed").otherwise("suspect").alias("state"), (count + 1).alias("count"), at.alias("counted_at"))
    same = F.struct(state.alias("state"), count.alias("count"), counted_at.alias("counted_at"))
    return F.when(present, F.struct(F.lit("active").alias("state"), F.lit(0).alias("count"), F.lit(None).cast("timestamp_ntz").alias("counted_at"))).when(due, missed).otherwise(same)


def fold_absences(seen: DataFrame, snapshots: DataFrame, required: int, interval_hours: int) -> DataFrame:
    """source_id, stable_key, state, count, counted_at after all authoritative snapshots in order of time.

    seen: source_id, stable_key, at (times at which it was present); snapshots: source_id, at. A key's life begins with
    its first presence, and every presence begins it anew; so only the snapshots after the last one are stepped through.
    Snapshots of a source are one list, not rows repeated for each key and snapshot.
    """
    times = snapshots.groupBy("source_id").agg(F.array_sort(F.collect_set("at")).alias("all"))
    keys = seen.groupBy("source_id", "stable_key").agg(F.max("at").alias("last")).join(times, "source_id")
    interval = F.make_dt_interval(hours=F.lit(interval_hours))
    start = F.struct(F.lit("active").alias("state"), F.lit(0).alias("count"), F.lit(None).cast("timestamp_ntz").alias("counted_at"))
    later = F.filter("all", lambda at: at > F.col("last"))
    step = lambda s, at: absence_step(s["state"], s["count"], s["counted_at"], F.lit(False), at, required, interval)
    return keys.select("source_id", "stable_key", F.aggregate(later, start, step).alias("s")).select("source_id", "stable_key", "s.*")


def transitions(old: DataFrame, new: DataFrame, key: str, at: Column) -> DataFrame:
    """Log rows for keys whose state changed."""
    both = new.select(key, F.col("state").alias("to_state")).join(old.select(key, F.col("state").alias("from_state")), key, "left")
    return both.where(~F.col("to_state").eqNullSafe(F.col("from_state"))).withColumn("at", at)


def adopts_source(current: Column, bound_run: Column, incoming: Column) -> Column:
    """A stronger origin takes the candidate over, or an equal one if no authoritative run is bound yet."""
    rank = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in ORIGINS.items()], F.lit(0))
    return (rank(incoming) > rank(current)) | ((rank(incoming) == rank(current)) & bound_run.isNull())


def ingest(leads: DataFrame, tombstones: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates from observations: replays of an observation key count once; the order of rows does not matter.

    leads: identity, observation_key, observed_at, origin_kind, company, title, official_url, priority (p0 to p3),
    location_state. tombstones: identity of what must not come back. known: observation_key of earlier batches.
    Texts take the longest value, URLs the first, priority the most urgent, location never goes back from japan.
    """
    fresh = leads.groupBy("identity", "observation_key").agg(F.min_by(F.struct(*[c for c in leads.columns if c not in ("identity", "observation_key")]), "observed_at").alias("x")).select("identity", "observation_key", "x.*")
    if known is not None:
        fresh = fresh.join(known.select("observation_key"), "observation_key", "left_anti")
    live = fresh.join(tombstones.select("identity"), "identity", "left_anti")
    when = F.struct("observed_at", "observation_key")
    rank = F.coalesce(*[F.when(F.col("origin_kind") == k, v) for k, v in ORIGINS.items()], F.lit(0))
    return live.groupBy("identity").agg(
        F.count(F.lit(1)).alias("observation_count"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
        F.max_by("company", F.struct(F.char_length("company"), -F.unix_micros(F.col("observed_at").cast("timestamp")))).alias("company"), F.max_by("title", F.struct(F.char_length("title"), -F.unix_micros(F.col("observed_at").cast("timestamp")))).alias("title"),
        F.min_by("official_url", F.when(F.col("official_url").isNotNull(), when)).alias("official_url"), F.min("priority").alias("priority"),
        F.max_by("origin_kind", F.struct(rank, -F.unix_micros(F.col("observed_at").cast("timestamp")))).alias("origin_kind"),
        F.when(F.bool_or(F.col("location_state") == "japan"), "japan").otherwise(F.max_by("location_state", when)).alias("location_state"))


def touched_tombstones(leads: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Tombstones (identity, last_seen_at) with the times at which their leads came again."""
    again = leads.groupBy("identity").agg(F.max("observed_at").alias("_again"))
    return tombstones.join(again, "identity", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "_again")).drop("_again")


def authoritative_marks(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations that may mark a candidate: bound to a run that succeeded and is complete."""
    good = runs.where((F.col("status") == "succeeded") & F.col("complete")).select("run_id")
    return observations.join(good, "run_id", "left_semi")


def outcome(attempt: Column, failed: Column, retryable: Column, most: int, now: Column) -> Column:
    """struct(state, available_at) of an attempt that ended: done, waiting for its next turn, or failed for good."""
    again = failed & retryable & (attempt < most)
    later = now + F.make_dt_interval(secs=retry_seconds(attempt))
    return F.struct(F.when(~failed, "succeeded").when(again, "queued").otherwise("failed").alias("state"), F.when(again, later).alias("available_at"))


def claim(queue: DataFrame, now: Column, limit: int, lease_minutes: int, worker: str) -> DataFrame:
    """The first rows that are queued and due, or whose lease ran out, leased to a worker. One writer a queue; a file table has no row locks."""
    due = ((F.col("state") == "queued") & (F.col("available_at") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") < now))
    first = queue.where(due).orderBy("available_at", "id").limit(limit)
    return first.withColumns({"state": F.lit("leased"), "worker": F.lit(worker), "lease_until": now + F.make_dt_interval(mins=F.lit(lease_minutes)), "attempt": F.col("attempt") + 1})


def stale_leads(candidates: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Candidates of no official origin that nobody has seen for so long, expired."""
    old = (F.col("origin_kind") != "official_collection") & (F.col("last_seen_at") < now - F.make_dt_interval(days=F.lit(days))) & ~F.col("state").isin("rejected", "expired")
    return candidates.withColumn("state", F.when(old, "expired").otherwise(F.col("state")))


def discovery_mode(mode: Column) -> Column:
    """What a mode lets a collector do: fetch, observe only, or nothing."""
    return F.when(mode == "full", "fetch").when(mode == "metadata_only", "observe").otherwise("ignore")


def backfill_days(queue_empty: Column, verified_left: Column, low_growth_scans: Column, trusted: Column) -> Column:
    """183 days once there is nothing else to do and growth has stopped short of the aim; else the usual 30."""
    return F.when(queue_empty & (verified_left > 0) & (low_growth_scans >= 2) & (trusted < 5000), 183).otherwise(30)


def provider_error(status: Column, name: Column, message: Column) -> Column:
    """struct(code, retryable) of a model provider's error: refused or unfit requests are not tried again."""
    code = F.when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string"))).when(name == "TimeoutError", "timeout").when(F.coalesce(message, F.lit("")).rlike("(?i)invalid JSON"), "invalid_json").otherwise("provider_error")
    final = F.coalesce(status.isin(400, 401, 403, 404, 422), F.lit(False)) | F.coalesce(message, F.lit("")).rlike("(?i)schema|outside the current|quote")
    return F.struct(code.alias("code"), (~final).alias("retryable"))


def consecutive_days(passed: DataFrame, at: str, zone: str = "Asia/Tokyo") -> DataFrame:
    """day, consecutive (1 or 2) of the calendar days of a zone on which a check passed: 2 where it passed the day before too."""
    days = passed.select(F.to_date(F.from_utc_timestamp(F.col(at).cast("timestamp"), zone)).alias("day")).distinct()
    before = days.select(F.date_add("day", 1).alias("day"), F.lit(2).alias("_two"))
    return days.join(before, "day", "left").select("day", F.coalesce("_two", F.lit(1)).alias("consecutive"))
