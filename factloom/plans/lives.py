"""Queries of candidates' lives. Observations are made from events, some of them sent again later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.catalog import query
from factloom.session import table as t
from factloom.streaming import candidates


def observations(events: DataFrame) -> DataFrame:
    """Events as `candidates` takes them: every fifth a presence, every fortieth with a publication date, every third sent again."""
    i, lead = F.col("event_id"), F.col("event_id") % 5 != 0
    when = lambda c, v: F.when(lead & c, v)
    rows = events.select(
        F.col("user_id").cast("string").alias("identity"), i.cast("string").alias("observation_key"), F.col("ts").cast("timestamp").alias("ts"), F.when(lead, "lead").otherwise("presence").alias("kind"),
        F.when(lead, F.when((F.col("user_id") % 4 == 0) & (i % 50 == 7), "official_collection").when(i % 7 == 0, "search_index").otherwise("aggregator_lead")).alias("origin"), when(F.lit(True), F.col("event_type")).alias("company"), when(F.lit(True), F.col("props")).alias("title"),
        when(i % 9 == 0, F.concat(F.lit("u"), i.cast("string"))).alias("official_url"), when(F.lit(True), F.concat(F.lit("p"), (i % 4).cast("string"))).alias("priority"), when(F.lit(True), F.when(i % 31 == 0, "japan").when(i % 2 == 0, "abroad").otherwise("unknown")).alias("location_state"),
        when(i % 40 == 1, F.date_sub(F.to_date("ts"), (i % 250).cast("int"))).otherwise(when(i % 400 == 202, F.date_add(F.to_date("ts"), 10))).alias("published_on"), F.when(i % 6 == 0, True).alias("authoritative"))
    again = rows.where(F.col("observation_key").cast("long") % 3 == 0).withColumn("ts", F.col("ts") + F.expr("interval 2 days"))
    return rows.unionAll(again)


@query("STA-05", "STA-06", "STA-09", "STA-10", "STA-13", oracle="""
    WITH p AS (SELECT TIMESTAMP '2024-03-05' AS until),
    o AS (SELECT user_id::VARCHAR AS identity, event_id AS i, event_id::VARCHAR AS k, ts AS tm, event_id % 5 = 0 AS presence, CASE WHEN user_id % 4 = 0 AND event_id % 50 = 7 THEN 4 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS rank, event_type AS company, props AS title,
        CASE WHEN event_id % 40 = 1 THEN ts::DATE - (event_id % 250)::INT WHEN event_id % 400 = 202 THEN ts::DATE + 10 END AS published_on FROM events),
    b AS (SELECT * FROM o QUALIFY tm >= min(CASE WHEN NOT presence THEN tm END) OVER (PARTITION BY identity)),
    w AS (SELECT *, min(tm) OVER (PARTITION BY identity) AS begin, coalesce(lead(tm) OVER r, until) AS nxt, first_value(CASE WHEN NOT presence THEN published_on END IGNORE NULLS) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_on,
        bool_or(NOT presence AND rank = 4) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS official, row_number() OVER r AS n FROM b, p WINDOW r AS (PARTITION BY identity ORDER BY tm, presence, k)),
    d AS (SELECT *, coalesce(known_on > (tm + INTERVAL 9 HOUR)::DATE, false) AS future, CASE WHEN known_on IS NULL THEN begin + INTERVAL 7 DAY ELSE
        list_filter(list_transform(range(1, 5), lambda x: (known_on + INTERVAL 6 MONTH)::DATE + x::INT), lambda x: (x - INTERVAL 6 MONTH)::DATE > known_on)[1]::TIMESTAMP - INTERVAL 9 HOUR END AS due FROM w),
    f AS (SELECT *, CASE WHEN future THEN tm ELSE greatest(due, tm) END AS falls, CASE WHEN future THEN 'published_in_future' WHEN known_on IS NULL THEN 'publication_date_unknown_after_grace' ELSE 'published_older_than_retention_window' END AS why FROM d),
    e AS (SELECT *, min(CASE WHEN falls <= nxt THEN falls END) OVER (PARTITION BY identity) AS ended, first_value(CASE WHEN falls <= nxt THEN why END IGNORE NULLS) OVER (PARTITION BY identity ORDER BY CASE WHEN falls <= nxt THEN falls END NULLS LAST, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reason FROM f),
    a AS (SELECT *, ended IS NULL OR tm < ended AS alive FROM e),
    s AS (SELECT *, CASE WHEN alive AND NOT official AND tm + INTERVAL 30 DAY < nxt AND (ended IS NULL OR tm + INTERVAL 30 DAY < ended) THEN tm + INTERVAL 30 DAY END AS silent FROM a),
    g AS (SELECT identity, any_value(reason) AS reason, any_value(ended) AS ended_at, min(silent) AS stale_at, count(*) FILTER (alive) AS observation_count, min(tm) FILTER (alive) AS first_seen_at, max(tm) AS last_seen_at, max(tm) FILTER (alive AND i % 6 = 0) AS last_authoritative_seen_at,
        max(rank) FILTER (alive AND NOT presence) AS rank, arg_min(company, (-len(company), tm, k)) FILTER (alive AND NOT presence) AS company, arg_min(title, (-len(title), tm, k)) FILTER (alive AND NOT presence) AS title,
        arg_min('u' || k, (tm, k)) FILTER (alive AND NOT presence AND i % 9 = 0) AS official_url, min('p' || (i % 4)) FILTER (alive AND NOT presence) AS priority, bool_or(i % 31 = 0) FILTER (alive AND NOT presence) AS japan, arg_max(i % 2, (tm, k)) FILTER (alive AND NOT presence) AS odd,
        arg_min(published_on, (tm, k)) FILTER (alive AND NOT presence AND published_on IS NOT NULL) AS published_on FROM s GROUP BY identity)
    SELECT identity, CASE WHEN ended_at IS NOT NULL THEN 'tombstoned' WHEN stale_at IS NOT NULL THEN 'expired' WHEN published_on IS NULL THEN 'quarantined' ELSE 'admitted' END AS state, reason, ended_at, stale_at, observation_count::BIGINT AS observation_count, first_seen_at, last_seen_at, last_authoritative_seen_at,
        CASE rank WHEN 4 THEN 'official_collection' WHEN 2 THEN 'search_index' WHEN 1 THEN 'aggregator_lead' END AS origin, company, title, official_url, priority, CASE WHEN japan THEN 'japan' WHEN odd = 0 THEN 'abroad' WHEN odd = 1 THEN 'unknown' END AS location_state, published_on FROM g""")
def candidate_lives(spark: SparkSession, d: str) -> DataFrame:
    """What became of every candidate by a day in March."""
    lives = candidates.lives(observations(t(spark, d, "events")), F.lit("2024-03-05 00:00:00").cast("timestamp"))
    return lives.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ended_at", "stale_at", "first_seen_at", "last_seen_at", "last_authoritative_seen_at")})
