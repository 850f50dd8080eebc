"""Queries of state: snapshots, breakers, lifecycles, ingest, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates
from factloom.plans.catalog import query
from factloom.plans.relational import ntz
from factloom.session import table as t
from factloom.streaming import state


@query("DAT-01", "STA-12", "AGG-19", oracle="""
    SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tokyo_daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy(dates.tokyo_date(F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("DAT-10", "STA-11", oracle="""SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events""")
def hour_bucket(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("user_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).distinct()


@query("STA-09", "PRO-18", oracle="""
    WITH a AS (SELECT event_id, user_id, ts FROM events UNION ALL SELECT event_id, user_id, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 3 = 0), o AS (SELECT event_id, user_id, min(ts) AS ts FROM a GROUP BY ALL)
    SELECT user_id, count(*) AS observation_count, max(ts) AS last_seen_at FROM o GROUP BY user_id""")
def dedup_observations(spark: SparkSession, d: str) -> DataFrame:
    """A replay with a later time changes nothing."""
    events = t(spark, d, "events").select("event_id", "user_id", "ts")
    replayed = events.union(events.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour")))
    first = replayed.groupBy("event_id", "user_id").agg(F.min("ts").alias("ts"))
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("observation_count"), F.max("ts").alias("last_seen_at"))


@query("STA-05", "STA-06", "DML-03", oracle="""
    WITH o AS (SELECT user_id AS identity, event_id, min(ts) AS ts, any_value(event_type) AS event_type, any_value(props) AS props FROM events GROUP BY ALL), l AS (SELECT * FROM o WHERE identity % 17 <> 3)
    SELECT identity, count(*) AS observation_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at, arg_max(props, (length(props), -epoch_us(ts))) AS title, min('p' || (event_id % 4)::VARCHAR) AS priority,
        arg_min(event_type, (ts, event_id::VARCHAR)) FILTER (event_type = 'signup') AS official_url, CASE max(CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 2 ELSE 1 END) WHEN 4 THEN 'official_collection' WHEN 2 THEN 'search_index' ELSE 'aggregator_lead' END AS origin_kind,
        CASE WHEN bool_or(event_type = 'view') THEN 'japan' ELSE 'unknown' END AS location_state FROM l GROUP BY identity""")
def ingest_leads(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    leads = t(spark, d, "events").select(
        F.col("user_id").alias("identity"), F.col("event_id").cast("string").alias("observation_key"), F.col("ts").alias("observed_at"), F.when(kind == "purchase", "official_collection").when(kind == "click", "search_index").otherwise("aggregator_lead").alias("origin_kind"),
        F.lit("x").alias("company"), F.col("props").alias("title"), F.when(kind == "signup", kind).alias("official_url"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("priority"), F.when(kind == "view", "japan").otherwise("unknown").alias("location_state"))
    gone = leads.select("identity").where("identity % 17 = 3").distinct()
    return state.ingest(leads.union(leads.where("identity % 2 = 0")), gone).drop("company")


@query("FIL-01", "FIL-02", "STA-10", oracle="""
    WITH c AS (SELECT user_id, count(*) AS n, max(ts) AS last, max(ts) FILTER (event_type = 'purchase') AS auth FROM events GROUP BY user_id)
    SELECT user_id, coalesce(user_id % 5 <> 0 AND user_id % 7 <> 0 AND user_id % 3 <> 0 AND CASE WHEN user_id % 2 = 0 THEN auth IS NOT NULL AND auth >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR ELSE n >= 2 AND last >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR END, false) AS valid,
        coalesce(user_id % 5 <> 0 AND user_id % 7 <> 0 AND CASE WHEN user_id % 2 = 0 THEN auth IS NOT NULL AND auth >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR ELSE n >= 2 AND last >= TIMESTAMP '2024-01-31' - INTERVAL 720 HOUR END, false) AS valid_in_summary FROM c""")
def valid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Also FIL-02, the summary's variant, under its own name."""
    u = F.col("user_id")
    c = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("observation_count"), F.max("ts").alias("last_seen_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_authoritative_seen_at"))
    c = c.withColumns({"location_state": F.when(u % 5 != 0, "japan").otherwise("unknown"), "state": F.when(u % 7 == 0, "rejected").otherwise("queued"), "publication_freshness": F.when(u % 3 != 0, "recent").otherwise("expired"), "origin_kind": F.when(u % 2 == 0, "official_collection").otherwise("aggregator_lead"), "last_authoritative_import_run_id": F.col("last_authoritative_seen_at").cast("string")})
    return c.select("user_id", dates.is_valid_candidate(ntz()).alias("valid"), dates.is_valid_candidate(ntz(), with_recent=False).alias("valid_in_summary"))


@query("DAT-05", "DAT-02", "DAT-08", oracle="""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS p, o_orderdate AS seen, TIMESTAMP '1998-01-31 20:00:00' AS now, DATE '1998-02-01' AS today, DATE '1997-08-01' AS cutoff FROM orders)
    SELECT o_orderkey, CASE WHEN p IS NULL THEN CASE WHEN now >= seen + INTERVAL 7 DAY THEN 'expired' ELSE 'unknown_quarantine' END WHEN p > today OR p < cutoff THEN 'expired' ELSE 'recent' END AS freshness,
        CASE WHEN p IS NULL THEN CASE WHEN now >= seen + INTERVAL 7 DAY THEN 'publication_date_unknown_after_grace' ELSE 'publication_date_unknown' END WHEN p > today THEN 'published_in_future' WHEN p < cutoff THEN 'published_older_than_retention_window' ELSE 'published_within_retention_window' END AS reason,
        (p + INTERVAL 6 MONTH)::DATE AS expires FROM o""")
def freshness_decision(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("p"), F.col("o_orderdate").cast("timestamp").alias("seen"))
    f = dates.freshness(F.col("p"), F.col("seen"), F.lit("1998-01-31 20:00:00").cast("timestamp"))
    return o.select("o_orderkey", f["freshness"].alias("freshness"), f["reason"].alias("reason"), dates.retention_expires(F.col("p")).alias("expires"))


@query("DAT-06", "DAT-07", "DAT-03", "DAT-08", oracle="""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS p FROM orders)
    SELECT o_orderkey, coalesce(p BETWEEN DATE '1997-03-04' AND DATE '1997-04-03', false) AS eligible, CASE WHEN p IS NULL THEN 'publication_date_unknown' WHEN p > DATE '1997-04-03' THEN 'published_in_future' WHEN p < DATE '1997-03-04' THEN 'published_before_lookback_window' ELSE 'published_within_lookback_window' END AS reason,
        coalesce(p BETWEEN DATE '1997-03-05' AND DATE '1997-04-03', false) AS in_scan FROM o""")
def lookback(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1997-04-02 18:00:00").cast("timestamp")
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("p"))
    found = dates.lookback(F.col("p"), 30, now)
    return o.select("o_orderkey", found["eligible"].alias("eligible"), found["reason"].alias("reason"), dates.in_scanner_window(F.col("p"), 30, now).alias("in_scan"))


@query("DAT-09", "DAT-11", "DAT-12", oracle="""
    WITH x AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (12 + o_orderkey % 48) AS stale_at, o_orderstatus <> 'P' AS active, o_orderkey % 4 = 0 AS saved, o_orderkey % 6 = 0 AS applied, o_orderkey % 9 <> 0 AS verified, o_orderkey % 5 <> 0 AS allowed, CASE WHEN o_orderkey % 11 = 0 THEN 'workday' ELSE 'hrmos' END AS kind, o_orderdate AS f FROM orders),
    y AS (SELECT *, TIMESTAMP '1997-06-01' >= stale_at AS stale, CASE WHEN NOT active THEN 'job_inactive' WHEN NOT saved AND NOT applied THEN 'save_or_apply_required' WHEN NOT verified THEN 'source_unverified' WHEN NOT allowed OR kind = 'workday' THEN 'source_not_refreshable' WHEN TIMESTAMP '1997-06-01' < stale_at THEN 'source_not_stale' END AS reason FROM x)
    SELECT o_orderkey, stale_at, stale, reason IS NULL AS eligible, reason, CASE WHEN TIMESTAMP '1997-06-01' - f <= INTERVAL 24 HOUR THEN 2 WHEN TIMESTAMP '1997-06-01' - f <= INTERVAL 168 HOUR THEN 1 ELSE 0 END AS score, least(3600, 15 * 2 ** (o_orderkey % 12))::BIGINT AS retry_s, least(24, 2 ** least(o_orderkey % 12, 4))::BIGINT AS retry_h FROM y""")
def refresh_policy(spark: SparkSession, d: str) -> DataFrame:
    k, now = F.col("o_orderkey"), ntz("1997-06-01 00:00:00")
    kind = F.when(k % 11 == 0, "workday").otherwise("hrmos")
    p = dates.refresh_policy(F.when(F.col("o_orderstatus") != "P", "active").otherwise("closed"), k % 4 == 0, k % 6 == 0, k % 9 != 0, k % 5 != 0, kind, F.col("o_orderdate"), (12 + k % 48).cast("int"), now)
    score = dates.freshness_score(F.col("o_orderdate").cast("timestamp"), F.lit("1997-06-01").cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", p.alias("p"), score.alias("score"), dates.retry_seconds(k % 12 + 1).alias("retry_s"), dates.retry_hours(k % 12).alias("retry_h")).select("o_orderkey", "p.*", "score", "retry_s", "retry_h")


@query("STA-02", oracle="""
    WITH r AS (SELECT event_type AS source_id, ts::DATE AS day, user_id AS k FROM events GROUP BY ALL), days AS (SELECT DISTINCT source_id, day FROM r),
    c AS (SELECT source_id, day, count(*) AS jobs FROM r GROUP BY ALL), p AS (SELECT source_id, day + 1 AS day, count(*) AS previous FROM r GROUP BY ALL),
    s AS (SELECT a.source_id, a.day + 1 AS day, count(*) AS still FROM r a JOIN r b ON a.source_id = b.source_id AND a.k = b.k AND b.day = a.day + 1 GROUP BY ALL),
    x AS (SELECT source_id, day, jobs, coalesce(previous, 0) AS previous, coalesce(previous, 0) - coalesce(still, 0) AS missing FROM c LEFT JOIN p USING (source_id, day) LEFT JOIN s USING (source_id, day))
    SELECT source_id, day, jobs, previous, missing, array_to_string(CASE WHEN missing = 0 THEN [] ELSE list_filter([CASE WHEN previous >= 5 AND jobs = 0 THEN 'unexpected_zero' END, CASE WHEN missing / nullif(previous, 0) > 0.5 THEN 'missing_ratio_exceeded' END, CASE WHEN missing > 25 THEN 'missing_absolute_exceeded' END], lambda v: v IS NOT NULL) END, ',') AS reasons FROM x""")
def closure_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Each day's snapshot of each source against the day before."""
    rows = t(spark, d, "events").select(F.col("event_type").alias("source_id"), F.to_date("ts").alias("day"), F.col("user_id").alias("k")).distinct()
    before = rows.withColumn("day", F.date_add("day", 1))
    jobs, previous = rows.groupBy("source_id", "day").agg(F.count(F.lit(1)).alias("jobs")), before.groupBy("source_id", "day").agg(F.count(F.lit(1)).alias("previous"))
    still = before.join(rows, ["source_id", "day", "k"], "left_semi").groupBy("source_id", "day").agg(F.count(F.lit(1)).alias("still"))
    x = jobs.join(previous, ["source_id", "day"], "left").join(still, ["source_id", "day"], "left").fillna(0, ["previous", "still"]).withColumn("missing", F.col("previous") - F.col("still"))
    reasons = state.breaker_reasons(F.col("previous"), F.col("jobs"), F.col("missing"), state.Breaker())
    return x.select("source_id", "day", "jobs", "previous", "missing", F.array_join(reasons, ",").alias("reasons"))


@query("STA-03", oracle="""
    WITH RECURSIVE s AS (SELECT event_type AS source_id, list_sort(list(DISTINCT date_trunc('day', ts))) AS days FROM events GROUP BY 1),
    k AS (SELECT event_type AS source_id, user_id, list(DISTINCT date_trunc('day', ts)) AS present, min(date_trunc('day', ts)) AS first FROM events GROUP BY 1, 2),
    a AS (SELECT k.source_id, user_id, present, list_filter(days, lambda x: x >= first) AS days FROM k JOIN s USING (source_id)),
    r AS (SELECT source_id, user_id, present, days, 0 AS i, 'active' AS state, 0 AS count, NULL::TIMESTAMP AS counted_at FROM a
        UNION ALL SELECT source_id, user_id, present, days, i + 1, CASE WHEN list_contains(present, days[i + 1]) THEN 'active' WHEN counted_at IS NULL OR days[i + 1] >= counted_at + INTERVAL 48 HOUR THEN CASE WHEN count + 1 >= 3 THEN 'closed' ELSE 'suspect' END ELSE state END,
            CASE WHEN list_contains(present, days[i + 1]) THEN 0 WHEN counted_at IS NULL OR days[i + 1] >= counted_at + INTERVAL 48 HOUR THEN count + 1 ELSE count END,
            CASE WHEN list_contains(present, days[i + 1]) THEN NULL WHEN counted_at IS NULL OR days[i + 1] >= counted_at + INTERVAL 48 HOUR THEN days[i + 1] ELSE counted_at END FROM r WHERE i < len(days))
    SELECT source_id, user_id::VARCHAR AS stable_key, state, count, counted_at FROM r WHERE i = len(days)""")
def absence_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    seen = t(spark, d, "events").select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("stable_key"), F.to_date("ts").cast("timestamp_ntz").alias("at")).distinct()
    return state.fold_absences(seen, seen.select("source_id", "at").distinct(), required=3, interval_hours=48)


@query("STA-08", oracle="""SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING')""")
def authoritative_marks(spark: SparkSession, d: str) -> DataFrame:
    runs = t(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_acctbal") > 0, "succeeded").otherwise("failed").alias("status"), (F.col("c_mktsegment") == "BUILDING").alias("complete"))
    return state.authoritative_marks(t(spark, d, "events").select("event_id", F.col("user_id").alias("run_id")), runs).select("event_id")


@query("STA-13", oracle="""
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1996-06-01' - INTERVAL 30 DAY AND o_orderpriority <> '5-LOW' THEN 'expired' WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'queued' END AS state FROM orders""")
def stale_leads(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "official_collection").otherwise("aggregator_lead").alias("origin_kind"), F.col("o_orderdate").alias("last_seen_at"), F.when(F.col("o_orderpriority") == "5-LOW", "rejected").otherwise("queued").alias("state"))
    return state.stale_leads(c, ntz("1996-06-01 00:00:00")).select("o_orderkey", "state")


@query("STA-15", oracle="""
    SELECT event_id, CASE WHEN event_type <> 'error' THEN 'succeeded' WHEN value < 30 AND event_id % 5 + 1 < 4 THEN 'queued' ELSE 'failed' END AS state,
        CASE WHEN event_type = 'error' AND value < 30 AND event_id % 5 + 1 < 4 THEN ts + INTERVAL 1 SECOND * least(3600, 15 * 2 ** (event_id % 5))::BIGINT END AS available_at FROM events""")
def attempt_outcome(spark: SparkSession, d: str) -> DataFrame:
    o = state.outcome(F.col("event_id") % 5 + 1, F.col("event_type") == "error", F.coalesce(F.col("value") < 30, F.lit(False)), 4, F.col("ts"))
    return t(spark, d, "events").select("event_id", o.alias("o")).select("event_id", "o.*")


@query("STA-14", oracle="""
    SELECT o_orderkey AS id, 'leased' AS state, o_orderkey % 3 + 1 AS attempt FROM orders WHERE (o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1995-01-01') OR (o_orderstatus = 'P' AND o_orderdate + INTERVAL 10 MINUTE < TIMESTAMP '1995-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 40""")
def lease_claim(spark: SparkSession, d: str) -> DataFrame:
    queue = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "leased").otherwise("done").alias("state"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderdate") + F.expr("interval 10 minutes")).alias("lease_until"), (F.col("o_orderkey") % 3).alias("attempt"))
    return state.claim(queue, ntz("1995-01-01 00:00:00"), 40, 10, "w1").select("id", "state", "attempt")


@query("STA-16", "STA-17", oracle="""
    SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND n_regionkey = 1 AND (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) = (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def completion_guard(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose evidence is complete: as many suppliers as items, and all joins match."""
    full = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("a"), F.count(F.lit(1)).alias("b")).where("a = b")
    people = t(spark, d, "customer").join(t(spark, d, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(people, "o_custkey", "left_semi").join(full, "o_orderkey", "left_semi").select("o_orderkey")


@query("STA-21", "STA-19", oracle="""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'fetch' WHEN s_suppkey % 3 = 1 THEN 'observe' ELSE 'ignore' END AS does, CASE WHEN s_acctbal < 0 AND s_nationkey > 0 AND s_suppkey % 4 >= 2 AND s_suppkey < 5000 THEN 183 ELSE 30 END AS days FROM supplier""")
def mode_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select("s_suppkey", state.discovery_mode(F.when(k % 3 == 0, "full").when(k % 3 == 1, "metadata_only").otherwise("off")).alias("does"), state.backfill_days(F.col("s_acctbal") < 0, F.col("s_nationkey"), k % 4, k).alias("days"))


@query("STA-22", "DML-01", "PRO-17", oracle="""
    SELECT count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS would_insert, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS would_update FROM (SELECT DISTINCT o_custkey FROM orders)""")
def import_dry_run(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.combine import exists_flag

    old = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    new = t(spark, d, "orders").select("o_custkey").distinct()
    return exists_flag(new, old, ["o_custkey"], "known").agg(F.count_if(~F.col("known")).alias("would_insert"), F.count_if("known").alias("would_update"))


@query("DML-07", "DML-09", "DML-10", "DAT-08", oracle="""
    WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-01-01')
    SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'audit', count(*) FROM gone UNION ALL SELECT 'orphan_parts', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone))""")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import tables

    orders, lines = t(spark, d, "orders").select("o_orderkey", "o_orderdate"), t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    _, audit = tables.with_audit(orders, F.col("o_orderdate") < ntz("1994-01-01 00:00:00"), "retention")
    left = tables.purge({"orders": (orders, "o_orderkey"), "lineitem": (lines, "l_orderkey")}, audit.select(F.col("o_orderkey").alias("key")))
    lost = tables.orphans(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), left["lineitem"], "l_partkey")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count(left["orders"], "orders").union(count(left["lineitem"], "lineitem")).union(count(audit, "audit")).union(count(lost, "orphan_parts"))
