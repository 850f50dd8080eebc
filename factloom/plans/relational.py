"""Relational queries: joins, aggregations, ordering, distinct and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import combine, ranking
from factloom.plans.catalog import query
from factloom.session import table as t

AS_OF = "2024-01-31 00:00:00"


def ntz(text: str = AS_OF) -> Column:
    """The tables' timestamps have no zone; nor may what they are compared with."""
    return F.lit(text).cast("timestamp_ntz")


@query("JOI-04", "AGG-01", "DUP-01", "JOI-02", oracle="""
    WITH l AS (SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    c AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
        count(*) FILTER (event_type = 'error' AND value > 10) AS large_errors, count(DISTINCT event_type) FILTER (value IS NOT NULL) AS kinds, max(ts) AS last_ts FROM events GROUP BY user_id)
    SELECT c.user_id, n_events, clicks, purchases, large_errors, kinds, last_ts, event_id AS last_event_id, event_type AS last_event_type FROM c JOIN l USING (user_id)""")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Counts by condition and the newest row of each user, in one aggregation over one shuffle."""
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    out = t(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 10)).alias("large_errors"), F.size(F.collect_set(F.when(F.col("value").isNotNull(), F.col("event_type")))).cast("long").alias("kinds"),
        F.max("ts").alias("last_ts"), newest.alias("_n"))
    return out.select("*", F.col("_n.event_id").alias("last_event_id"), F.col("_n.event_type").alias("last_event_type")).drop("_n")


@query("DUP-01", "JOI-04", oracle="""SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) <= 3""")
def distinct_on_top3(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_one(t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal"), ["c_nationkey"], F.desc("c_acctbal"), F.desc("c_custkey"), k=3)


@query("JOI-01", oracle="""
    SELECT r_name, n_name, count(*) AS items, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderstatus <> 'P' GROUP BY r_name, n_name""")
def six_way_join(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    # one row an order first, so that the distinct count of orders needs no second shuffle of line items
    each = joined.groupBy("r_name", "n_name", "o_orderkey").agg(F.count(F.lit(1)).alias("i"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return each.groupBy("r_name", "n_name").agg(F.sum("i").alias("items"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("v"), 2).alias("revenue"))


@query("JOI-05", "SRT-05", oracle="""
    WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1)
    SELECT c_custkey, c_mktsegment, o_orderkey, o_orderdate FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def latest_order_or_none(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return combine.with_top_one(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"], F.col("o_orderdate").desc_nulls_last(), "o_orderkey", how="left")


@query("JOI-03", "PRO-03", "AGG-02", oracle="""
    SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderkey) > 0 AS active FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def zero_preserving_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return combine.counts_with_zero(t(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", "orders").withColumn("active", F.col("orders") > 0)


@query("JOI-09", "FIL-03", oracle="""SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND s_acctbal > 0)""")
def orders_with_returns(spark: SparkSession, d: str) -> DataFrame:
    good = t(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    returned = t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").join(good, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("JOI-10", oracle="""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orders_without_items(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(t(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("JOI-11", "FIL-08", oracle="""
    SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS without_items,
        count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F') AS not_finished FROM orders GROUP BY o_orderpriority""")
def anti_in_aggregate(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    flagged = combine.exists_flag(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), lines, ["o_orderkey"], "has_items")
    return flagged.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.count_if(~F.col("has_items")).alias("without_items"), F.count_if(~F.nullif("o_orderstatus", F.lit("P")).eqNullSafe(F.lit("F"))).alias("not_finished"))


@query("JOI-06", "AGG-10", oracle="""
    WITH f AS (SELECT l_orderkey, l_returnflag, list_sort(list(l_linenumber)) AS lines FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, to_json(map_from_entries(list(struct_pack(k := l_returnflag, v := lines) ORDER BY l_returnflag)))::VARCHAR AS lines_by_flag FROM f GROUP BY l_orderkey""")
def evidence_map(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return combine.grouped_map(lines, "l_orderkey", "l_returnflag", "l_linenumber").select("l_orderkey", F.to_json("by_field").alias("lines_by_flag"))


@query("JOI-07", oracle="""
    SELECT field, state, count(*) AS n FROM (SELECT l_orderkey, unnest(['flag', 'status']) AS field, unnest([l_returnflag, l_linestatus]) AS state FROM lineitem) GROUP BY ALL""")
def pivot_facts(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return combine.facts_by_field(lines, "l_orderkey", ["flag", "status"]).groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"))


@query("JOI-08", "AGG-07", oracle="""
    SELECT source, count(*) AS n, round(count(*) / (SELECT nullif(count(*), 0) FROM documents WHERE n_chars >= 100), 4) AS share FROM documents WHERE n_chars >= 100 GROUP BY source""")
def family_share(spark: SparkSession, d: str) -> DataFrame:
    return combine.share_of_total(t(spark, d, "documents").select("source", "n_chars"), "source", 4, F.col("n_chars") >= 100)


@query("AGG-05", "STR-08", oracle="""SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return combine.duplicate_groups(t(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash")), "text_hash")


@query("AGG-06", oracle="""SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS firsts FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber = 1) <> 1""")
def broken_invariants(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("firsts")).where("firsts <> 1")


@query("AGG-03", oracle="""SELECT l_returnflag, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem GROUP BY l_returnflag""")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a null part count, as in a row constructor: a struct, not two arguments."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_suppkey", "l_partkey")).alias("pairs"))


@query("AGG-04", "SRT-12", oracle="""SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20""")
def top_brands(spark: SparkSession, d: str) -> DataFrame:
    return combine.histogram(t(spark, d, "part"), F.col("p_brand"), "p_brand").limit(20)


@query("AGG-08", "DML-04", oracle="""
    SELECT s_nationkey, max(s_acctbal) AS best, min(s_suppkey) AS first_supplier, bool_or(s_acctbal < 0) AS any_debt, coalesce(max(s_name) FILTER (s_acctbal > 5000), 'none') AS rich FROM supplier GROUP BY s_nationkey""")
def merge_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"), F.min("s_suppkey").alias("first_supplier"), F.bool_or(F.col("s_acctbal") < 0).alias("any_debt"), F.coalesce(F.max(F.when(F.col("s_acctbal") > 5000, F.col("s_name"))), F.lit("none")).alias("rich"))


@query("AGG-09", oracle="""SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments FROM customer GROUP BY c_nationkey""")
def distinct_array(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("AGG-11", "DAT-10", oracle=f"""SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS tokens FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    recent = t(spark, d, "events").where((F.col("ts") >= ntz("2024-01-17 00:00:00")) & (F.col("ts") < ntz()))
    return recent.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("tokens"))


@query("AGG-12", "STA-19", oracle="""SELECT count(*) FILTER (value < 20) AS low FROM (SELECT value FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 2)""")
def recent_below(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(2).agg(F.count_if(F.col("value") < 20).alias("low"))


@query("AGG-15", oracle="""
    SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) FILTER (role = 'user') AS user_turns, arg_max(text, (length(text), -turn)) AS longest FROM conversations GROUP BY conv_id""")
def conversation_fold(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max_by("text", F.struct(F.char_length("text"), -F.col("turn"))).alias("longest"))


@query("AGG-16", oracle="""
    WITH c AS (SELECT count(*) FILTER (l_shipdate >= TIMESTAMP '1997-01-01') AS created, count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01') AS baseline FROM lineitem)
    SELECT created, baseline, CASE WHEN baseline = 0 THEN 0 ELSE round(created / baseline, 6) END AS growth FROM c""")
def growth_ratio(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("l_shipdate") >= ntz("1997-01-01 00:00:00")
    counts = t(spark, d, "lineitem").agg(F.count_if(late).alias("created"), F.count_if(~late).alias("baseline"))
    return counts.withColumn("growth", F.when(F.col("baseline") == 0, F.lit(0.0)).otherwise(F.round(F.col("created") / F.col("baseline"), 6)))


@query("AGG-17", oracle="""
    WITH x AS (SELECT toxic = 1 AS truth, quality = 0 AS said FROM labels), c AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM x)
    SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def label_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return combine.precision_recall(t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("AGG-18", oracle="""SELECT count(*) AS n, list_sort(list(value))[1 + floor(count(*) * 0.5)::INT] AS p50, list_sort(list(value))[ceil(count(*) * 0.95)::INT] AS p95 FROM events WHERE value IS NOT NULL""")
def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    return ranking.latency_percentiles(t(spark, d, "events"), "value")


@query("AGG-20", oracle="""SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey::VARCHAR || ':' || o_orderstatus)) AS fingerprint FROM orders GROUP BY o_custkey""")
def snapshot_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return combine.fingerprint(t(spark, d, "orders"), ["o_custkey"], F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("JOI-12", oracle="""
    SELECT a.event_id AS event_id, min(b.event_id) AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND date_trunc('day', a.ts) = date_trunc('day', b.ts) GROUP BY a.event_id""")
def same_parent_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Smallest event of another type of the same user and day; by aggregation, as only the smallest is asked for."""
    day = t(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    firsts = day.groupBy("user_id", "day", "event_type").agg(F.min("event_id").alias("first"))
    lists = firsts.groupBy("user_id", "day").agg(F.collect_list(F.struct("first", "event_type")).alias("firsts"))
    other = F.array_min(F.transform(F.filter("firsts", lambda x: x["event_type"] != F.col("event_type")), lambda x: x["first"]))
    return day.join(lists, ["user_id", "day"]).select("event_id", other.alias("other")).where("other is not null")


@query("JOI-13", oracle="""
    SELECT c_custkey, s_suppkey, min(CASE WHEN c_custkey = s_suppkey THEN 1 WHEN c_nationkey = s_nationkey AND round(c_acctbal) = round(s_acctbal) THEN 2 ELSE 3 END)::INTEGER AS matched_by
    FROM customer JOIN supplier ON c_custkey = s_suppkey OR (c_nationkey = s_nationkey AND round(c_acctbal) = round(s_acctbal)) OR right(c_name, 6) || c_nationkey = right(s_name, 6) || s_nationkey GROUP BY ALL""")
def any_key_match(spark: SparkSession, d: str) -> DataFrame:
    left = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("a1"), F.concat_ws(":", "c_nationkey", F.round("c_acctbal").cast("long")).alias("a2"), F.concat(F.right("c_name", F.lit(6)), F.col("c_nationkey").cast("string")).alias("a3"))
    right = t(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("b1"), F.concat_ws(":", "s_nationkey", F.round("s_acctbal").cast("long")).alias("b2"), F.concat(F.right("s_name", F.lit(6)), F.col("s_nationkey").cast("string")).alias("b3"))
    return combine.any_key_join(left, right, "c_custkey", "s_suppkey", [("a1", "b1"), ("a2", "b2"), ("a3", "b3")])


@query("JOI-14", oracle="""
    SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(regexp_replace(replace(c_name, 'Customer', ''), '[^[:alnum:]]', '', 'g')) = lower(regexp_replace(replace(s_name, 'Supplier', ''), '[^[:alnum:]]', '', 'g'))""")
def normalised_name_join(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c, word: F.lower(F.regexp_replace(F.replace(F.col(c), F.lit(word), F.lit("")), "[^0-9A-Za-z]", ""))
    left, right = t(spark, d, "customer").select("c_custkey", key("c_name", "Customer").alias("k")), t(spark, d, "supplier").select("s_suppkey", key("s_name", "Supplier").alias("k"))
    return left.join(right, "k").select("c_custkey", "s_suppkey")


@query("JOI-15", "RAG-02", oracle="""
    SELECT doc_id, arg_min(w, (-length(w), w)) AS name FROM documents, (SELECT DISTINCT text AS w FROM benchmark) WHERE contains(text, w) AND length(w) >= 4 GROUP BY doc_id""")
def longest_name_in_text(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "benchmark").select(F.col("text").alias("name"))
    return combine.longest_contained(t(spark, d, "documents").select("doc_id", "text"), names, "doc_id", "text", "name")


@query("JOI-16", oracle="""
    SELECT c_custkey, c_acctbal + coalesce(paid, 0) AS balance, paid IS NOT NULL AS updated FROM customer
    LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS paid FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def update_from_delete_using(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    paid = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("paid"))
    gone = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    kept = t(spark, d, "customer").select("c_custkey", "c_acctbal").join(gone, "c_custkey", "left_anti").join(paid, "c_custkey", "left")
    return kept.select("c_custkey", (F.col("c_acctbal") + F.coalesce("paid", F.lit(0.0))).alias("balance"), F.col("paid").isNotNull().alias("updated"))


@query("JOI-17", "FIL-05", oracle="""
    SELECT o_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderkey""")
def batched_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(orders, "o_orderkey", "left_semi")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return lines.groupBy("o_orderkey").agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("JOI-18", "DML-12", oracle="""
    WITH h AS (SELECT user_id, max(ts) AS head FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), n AS (SELECT user_id, arg_max(ts, (event_id)) AS incoming FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT coalesce(h.user_id, n.user_id) AS user_id, CASE WHEN head IS NULL OR incoming >= head THEN incoming ELSE head END AS head, coalesce(incoming >= head, head IS NULL) AS moved FROM h FULL JOIN n USING (user_id)""")
def head_not_older(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events")
    heads = events.where(F.col("ts") < ntz("2024-01-15 00:00:00")).groupBy("user_id").agg(F.max("ts").alias("old"))
    new = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("ts", "event_id").alias("incoming"))
    moves = F.coalesce(F.col("incoming") >= F.col("old"), F.col("old").isNull())
    return heads.join(new, "user_id", "full").select("user_id", F.when(moves, F.col("incoming")).otherwise(F.col("old")).alias("head"), moves.alias("moved"))


@query("SRT-01", oracle="""SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 12:00:00', 500) ORDER BY ts DESC, event_id DESC LIMIT 50""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    cursor = ranking.decode_cursor(ranking.encode_cursor(at="2024-01-20 12:00:00", id=500))
    return ranking.keyset_page(t(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id", (cursor["at"], cursor["id"]), 50)


@query("SRT-06", "STA-14", oracle="""
    WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
    q AS (SELECT *, i <= CASE o_orderpriority WHEN '1-URGENT' THEN 50 ELSE 25 END AS own FROM r), z AS (SELECT *, row_number() OVER (ORDER BY own DESC, o_orderdate, o_orderkey) AS n FROM q)
    SELECT o_orderkey, o_orderpriority, o_orderdate, NOT own AS borrowed FROM z WHERE n <= 100""")
def weighted_claim(spark: SparkSession, d: str) -> DataFrame:
    queue = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return ranking.weighted_claim(queue, "o_orderpriority", {"1-URGENT": 0.5, "2-HIGH": 0.25, "3-MEDIUM": 0.25}, 100, ["o_orderdate", "o_orderkey"])


@query("SRT-07", oracle="""
    WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 50 WHEN 'O' THEN 30 ELSE 20 END AS w FROM orders),
    y AS (SELECT *, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / w AS d FROM x)
    SELECT o_orderkey, o_orderstatus, floor(d) AS due, row_number() OVER (ORDER BY d, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS position FROM y""")
def fair_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    weights, order = {"F": 50, "O": 30, "P": 20}, [F.desc("o_totalprice"), "o_orderkey"]
    placed = ranking.place_by_due(ranking.fair_interleave(rows, "o_orderstatus", weights, "cost", order), "o_orderstatus", weights, order)
    return placed.select("o_orderkey", "o_orderstatus", F.floor("due").cast("double").alias("due"), "position")


@query("PRO-08", oracle="""
    WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13'))
    SELECT p_partkey, p_brand FROM r WHERE i <= 7 ORDER BY p_brand, p_partkey LIMIT 20""")
def quota_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quota_per_kind(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#11", "Brand#12", "Brand#13"], 20, ["p_partkey"])


@query("SRT-02", oracle="""
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS distance FROM embeddings, q WHERE vec_id <> 0 AND len(embedding) = len(e)
    ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5), vec_id LIMIT 200""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = t(spark, d, "embeddings").select("vec_id", "embedding")
    return cosine_nearest(vectors.where("vec_id <> 0"), vectors.where("vec_id = 0"), 200)


def cosine_nearest(vectors: DataFrame, one: DataFrame, k: int) -> DataFrame:
    """The k nearest of vectors (vec_id, embedding) to the one row of `one`, of equal length; distances to 5 digits."""
    q = one.select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding").cast("array<double>")
    near = vectors.join(F.broadcast(q)).where(F.size("embedding") == F.size("q")).select("vec_id", F.round(1 - dot(e, F.col("q")) / F.sqrt(dot(e, e) * dot(F.col("q"), F.col("q"))), 5).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(k)


@query("SRT-03", oracle="""
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id FROM embeddings, q WHERE vec_id <> 0 ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5), vec_id LIMIT 200)
    SELECT doc_id, doc_id IN (SELECT vec_id FROM k) AS semantic FROM documents WHERE doc_id IN (SELECT vec_id FROM k) OR (n_chars > 3000 AND doc_id NOT IN (SELECT vec_id FROM embeddings))""")
def recall_union(spark: SparkSession, d: str) -> DataFrame:
    vectors, docs = t(spark, d, "embeddings").select("vec_id", "embedding"), t(spark, d, "documents").select("doc_id", "n_chars")
    near = cosine_nearest(vectors.where("vec_id <> 0"), vectors.where("vec_id = 0"), 200).select(F.col("vec_id").alias("doc_id"))
    found = docs.join(near, "doc_id", "left_semi").select("doc_id", F.lit(True).alias("semantic"))
    rest = docs.where("n_chars > 3000").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", F.lit(False).alias("semantic"))
    return found.union(rest)


@query("SRT-04", "SCO-02", "SRT-08", oracle="""
    WITH s AS (SELECT c_custkey, c_name, least(100, greatest(0, floor(c_acctbal / 100)))::BIGINT AS score FROM customer)
    SELECT row_number() OVER (ORDER BY score DESC, c_name, c_custkey) AS rank, c_custkey, score FROM s""")
def rank_results(spark: SparkSession, d: str) -> DataFrame:
    scored = t(spark, d, "customer").select("c_custkey", "c_name", F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100))).cast("long").alias("score"))
    return ranking.ranked_by_score(scored, "score", "c_name", "c_custkey").select("rank", "c_custkey", "score")


@query("SRT-11", oracle="""SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 500""")
def purge_batch(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").where("event_type = 'error'").select("event_id", "ts").orderBy("ts", "event_id").limit(500)


@query("DUP-04", "SET-03", oracle="""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['audit']))), ',') AS kinds FROM events GROUP BY user_id""")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("event_type"), F.array(F.lit("audit")))), ",").alias("kinds"))


@query("DUP-05", oracle="""
    WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) SELECT doc_id, 'strong_duplicate_of:' || first AS reason FROM f WHERE doc_id <> first""")
def duplicate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Oldest of each group of equal texts stays; by aggregation and join, so that a hot group does not meet in one task."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id <> first").select("doc_id", F.concat(F.lit("strong_duplicate_of:"), F.col("first").cast("string")).alias("reason"))


@query("DUP-06", "DML-03", oracle="""
    SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS first_kind, arg_max(props, (length(props), -event_id)) AS longest_props, min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END)::INTEGER AS priority,
        bool_or(event_type = 'signup') AS known, max(ts) AS last_seen FROM events GROUP BY user_id""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Field-wise merge of observations: first value, longest text, most urgent priority, never downgraded flag, newest time."""
    urgency = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by(F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("event_type") != "view", F.struct("ts", "event_id"))).alias("first_kind"), F.max_by("props", F.struct(F.char_length("props"), -F.col("event_id"))).alias("longest_props"), F.min(urgency).alias("priority"), F.bool_or(F.col("event_type") == "signup").alias("known"), F.max("ts").alias("last_seen"))


@query("DUP-09", oracle="""SELECT l_orderkey, l_returnflag, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS line FROM lineitem GROUP BY ALL""")
def strongest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("line"))


@query("SET-01", "PRJ-01", oracle="""
    SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS detail, NULL::DOUBLE AS amount FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'order', o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal < 0""")
def task_list_union(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("detail"))
    b = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    c = t(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("detail"), F.col("s_acctbal").alias("amount"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SET-02", "RAG-05", oracle="""
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def reason_array(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query("FIL-06", "FIL-04", oracle="""SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END, (TIMESTAMP '1996-06-01 20:00:00' + INTERVAL 9 HOUR)::DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def range_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    fallback = F.to_date(F.from_utc_timestamp(F.lit("1996-06-01 20:00:00"), "Asia/Tokyo"))
    return t(spark, d, "orders").where(F.coalesce(known, fallback).between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("o_orderkey")


@query("FIL-07", "JSN-08", "SNK-04", oracle="""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.flag')::BOOLEAN, false) AS flag FROM events WHERE json_exists(props, '$.k')""")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long, flag boolean")
    return t(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["flag"], F.lit(False)).alias("flag")).where("k is not null")


@query("FIL-09", "FIL-10", oracle="""
    SELECT user_id, bool_or(event_type = 'purchase') AS applied, CASE WHEN bool_or(event_type = 'error') THEN 'hidden' WHEN bool_or(event_type = 'purchase') THEN 'applied' WHEN bool_or(event_type = 'click') THEN 'saved' ELSE 'recommendations' END AS view FROM events GROUP BY user_id""")
def view_filter(spark: SparkSession, d: str) -> DataFrame:
    has = lambda x: F.bool_or(F.col("event_type") == x)
    return t(spark, d, "events").groupBy("user_id").agg(has("purchase").alias("applied"), F.when(has("error"), "hidden").when(has("purchase"), "applied").when(has("click"), "saved").otherwise("recommendations").alias("view"))


@query("FIL-11", oracle="""SELECT l_orderkey, l_linenumber, NULL::BIGINT AS provider_total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)""")
def restricted_collection(spark: SparkSession, d: str) -> DataFrame:
    allowed = t(spark, d, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(allowed, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", F.lit(None).cast("long").alias("provider_total"))


@query("AGG-14", "CLS-05", oracle="""
    WITH f AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' END, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' END, CASE WHEN p_size < 20 THEN 'small' END, CASE WHEN p_type LIKE '%ECONOMY%' THEN 'economy' END], lambda x: x IS NOT NULL)) AS fs FROM part),
    a AS (SELECT unnest(['brass', 'steel', 'small', 'economy', 'unused']) AS family), c AS (SELECT unnest(fs) AS family, count(*) AS n FROM f GROUP BY 1)
    SELECT family, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (family)""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    families = F.array_compact(F.array(F.when(F.col("p_type").contains("BRASS"), "brass"), F.when(F.col("p_type").contains("STEEL"), "steel"), F.when(F.col("p_size") < 20, "small"), F.when(F.col("p_type").contains("ECONOMY"), "economy")))
    known = spark.createDataFrame([(x,) for x in ("brass", "steel", "small", "economy", "unused")], "family string")
    return combine.facet_counts(t(spark, d, "part"), "p_partkey", families, known)


@query("AGG-13", oracle="""SELECT lang AS key, count(*) AS n FROM documents GROUP BY lang""")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return combine.histogram(t(spark, d, "documents"), F.col("lang"))


@query("SRT-09", oracle="""SELECT user_id, arg_max(event_type, (length(event_type), event_type = 'purchase', event_id)) AS best FROM events GROUP BY user_id""")
def longest_match_wins(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(F.char_length("event_type"), F.col("event_type") == "purchase", "event_id")).alias("best"))


@query("STA-20", "AGG-19", oracle="""
    WITH p AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'error') / count(*) < 0.25 AS ok FROM events GROUP BY 1) SELECT a.day, a.ok AND b.ok AS two_days FROM p a JOIN p b ON b.day = a.day - 1""")
def two_consecutive_days(spark: SparkSession, d: str) -> DataFrame:
    days = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)) < 0.25).alias("ok"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("ok").alias("before"))
    return days.join(before, "day").select("day", (F.col("ok") & F.col("before")).alias("two_days"))


@query("PRO-15", oracle="""SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY o_custkey""")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


@query("PRO-16", "PRO-04", "DML-02", oracle="""
    WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), i AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT coalesce(o.k, i.k) AS k, coalesce(i.n, o.n) AS n, CASE WHEN i.k IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM o FULL JOIN i USING (k)""")
def upsert_report(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.tables import upsert

    early = F.col("o_orderdate") < ntz("1996-01-01 00:00:00")
    counts = lambda keep: t(spark, d, "orders").where(keep).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return upsert(counts(early), counts(~early), ["k"])


@query("SRT-10", oracle="""
    WITH s AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'ordinal': i - 1, 'line': x}), recursive := true) FROM documents),
    f AS (SELECT doc_id, ordinal, field, CASE WHEN field = 'first' AND ordinal = 0 THEN 100 ELSE 0 END + 10 * ((CASE WHEN contains(line, a) THEN 1 ELSE 0 END) + (CASE WHEN contains(line, b) THEN 1 ELSE 0 END)) AS score FROM s, (VALUES ('first', ' the ', ' der '), ('second', ' la ', ' en ')) k(field, a, b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, ordinal) AS i FROM f WHERE score > 0), u AS (SELECT DISTINCT doc_id, ordinal FROM r WHERE i <= 4)
    SELECT doc_id, ordinal::INTEGER AS ordinal FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) <= 8""")
def section_rank(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.retrieval import rank_sections

    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    fields = {"first": (F.col("ordinal") == 0, [" the ", " der "]), "second": (F.lit(False), [" la ", " en "])}
    return rank_sections(lines, "doc_id", "ordinal", "line", fields).select("doc_id", "ordinal")


@query(oracle="""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders""")
def running_total(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))
