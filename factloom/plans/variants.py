"""Queries of open JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import variants
from factloom.operators.tables import insert_if_absent
from factloom.plans.catalog import query
from factloom.session import spread
from factloom.session import table as t


def nested(k: Column, props: Column) -> Column:
    """An event's properties at several depths of a document, by the event's number: plain, in lists, below what the search reaches."""
    deep = lambda n, inner: F.concat(F.lit('{"d":' * n), inner, F.lit("}" * n))
    listed = F.concat(F.lit('{"items":[1,'), props, F.lit(',{"more":'), props, F.lit('}],"k":{"k":"inner"}}'))
    return F.when(k % 5 == 0, props).when(k % 5 == 1, listed).when(k % 5 == 2, deep(8, props)).when(k % 5 == 3, deep(9, props)).otherwise(F.concat(F.lit("["), props, F.lit(',"k",null]')))


@query("JSN-01", "FIL-07", oracle="""
    SELECT event_id, '$.k' AS path, k::VARCHAR AS value FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE event_id % 5 = 0 AND k IS NOT NULL
    UNION ALL SELECT event_id, p.path, CASE p.i WHEN 0 THEN '"inner"' WHEN 1 THEN '{"k":"inner"}' ELSE k END FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events), (VALUES (0, '$.k.k'), (1, '$.k'), (2, '$.items[000001].k'), (3, '$.items[000002].more.k')) p(i, path) WHERE event_id % 5 = 1 AND (p.i < 2 OR k IS NOT NULL)
    UNION ALL SELECT event_id, '$.d.d.d.d.d.d.d.d.k', k FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE event_id % 5 = 2 AND k IS NOT NULL
    UNION ALL SELECT event_id, '$[000000].k', k FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE event_id % 5 = 4 AND k IS NOT NULL""")
def keys_at_any_depth(spark: SparkSession, d: str) -> DataFrame:
    """All values of one key in documents made from events, eight levels deep and no deeper."""
    made = spread(t(spark, d, "events").select("event_id", "props")).select("event_id", F.try_parse_json(nested(F.col("event_id"), F.col("props"))).alias("doc"))
    found = variants.find_key(made, "doc", "k").select("event_id", F.explode("found").alias("f"))
    return found.select("event_id", F.col("f.path").alias("path"), F.to_json("f.value").alias("value"))


@query("SNK-04", "JSN-08", "DML-01", oracle="""
    WITH l AS (SELECT l_orderkey AS o_orderkey, l_linenumber, sum(l_quantity)::INTEGER AS quantity, bool_or(l_returnflag = 'R') AS returned, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN quantity END AS quantity, returned, '{"line":' || l_linenumber || ',"part":' || part || '}' AS breakdown FROM l WHERE l_linenumber > 1
    UNION ALL SELECT o_orderkey, 1, -1, NULL, NULL FROM l WHERE l_linenumber = 1""")
def record_set_insert(spark: SparkSession, d: str) -> DataFrame:
    """Items of each order as one JSON array, inserted by record: what is there stays, absent keys are null, open parts stay open."""
    k = F.col("l_linenumber")
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), k.cast("int").alias("l_linenumber")).agg(F.sum("l_quantity").cast("int").alias("quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.min("l_partkey").alias("part"))
    # quantities as texts, a key that no column takes, and none for every third line
    record = F.struct(k, F.when(k % 3 > 0, F.col("quantity").cast("string")).alias("quantity"), "returned", F.struct("part", k.alias("line")).alias("breakdown"), F.lit("x").alias("unused"))
    sets = lines.groupBy("o_orderkey").agg(F.to_json(F.collect_list(record)).alias("records"))
    new = variants.records(sets, "records", "l_linenumber int, quantity int, returned boolean, breakdown variant").withColumn("breakdown", F.to_json("breakdown"))
    there = lines.where(k == 1).select("o_orderkey", k, F.lit(-1).alias("quantity"), F.lit(None).cast("boolean").alias("returned"), F.lit(None).cast("string").alias("breakdown"))
    return insert_if_absent(there, new, ["o_orderkey", "l_linenumber"])


@query("JSN-08", "DML-04", "PRJ-01", oracle="""
    SELECT event_id, '{"event":"' || event_type || '","k":' || CASE WHEN event_id % 2 = 0 THEN '0' ELSE coalesce(json_extract_string(props, '$.k'), 'null') END || '}' AS merged, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END::INTEGER AS n, event_id % 2 = 0 OR json_exists(props, '$.k') AS has_k
    FROM events WHERE json_exists(props, '$.k')""")
def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """Properties with an object built beside and merged over them, and the length of lists put together."""
    e = t(spark, d, "events").select("event_id", "event_type", F.parse_json("props").alias("v")).where(variants.has_key(F.col("v"), "k"))
    over = F.to_variant_object(F.struct(F.col("event_type").alias("event")))
    zero = F.when(F.col("event_id") % 2 == 0, F.parse_json(F.lit('{"k":0}'))).otherwise(F.parse_json(F.lit("{}")))
    merged = variants.merge(variants.merge(F.col("v"), over), zero)
    lists = variants.merge(F.col("v"), F.when(F.col("event_id") % 3 == 0, F.parse_json(F.lit("[1]"))).otherwise(F.parse_json(F.lit("[1,2]"))))
    return e.select("event_id", F.to_json(merged).alias("merged"), variants.length(lists).alias("n"), variants.has_key(merged, "k").alias("has_k"))
