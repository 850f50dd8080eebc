"""Queries of canonical records: assignment, taking apart, versions, review tasks, evidence and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import canonical, entities, facts, tables
from factloom.plans.catalog import query
from factloom.session import scratch
from factloom.session import table as t

_NOW = "TIMESTAMP '1998-09-01 00:00:00'"


@query("MRG-04", oracle="""
    WITH l AS (SELECT s_suppkey AS record_id, s_suppkey % 50 AS canonical_id, 'u' || (s_suppkey % 40) AS url, s_nationkey AS company, s_suppkey % 11 AS posting, 1000 - s_suppkey AS active_from FROM supplier WHERE s_suppkey % 5 > 0),
    r AS (SELECT -c_custkey AS record_id, 'u' || (c_custkey % 60) AS url, c_nationkey AS company, CASE WHEN c_custkey % 13 < 11 THEN c_custkey % 13 END AS posting, c_custkey % 17 = 0 AS had, c_custkey % 10 = 0 AS linked FROM customer),
    u AS (SELECT url, arg_min(canonical_id, (active_from, record_id)) AS c FROM l GROUP BY url), p AS (SELECT company, posting, arg_min(canonical_id, (active_from, record_id)) AS c FROM l GROUP BY ALL),
    m AS (SELECT r.*, CASE WHEN had THEN 900 WHEN linked THEN 901 ELSE coalesce(u.c, p.c) END AS c, CASE WHEN had THEN 'existing_source' WHEN linked THEN 'official_link' WHEN u.c IS NOT NULL THEN 'application_url' WHEN p.c IS NOT NULL THEN 'posting_id' END AS how FROM r LEFT JOIN u USING (url) LEFT JOIN p ON p.company = r.company AND p.posting = r.posting),
    n AS (SELECT *, min(record_id) FILTER (c IS NULL) OVER (PARTITION BY url, c IS NULL) AS first FROM m)
    SELECT record_id, coalesce(c::VARCHAR, 'new-' || first) AS canonical_id, coalesce(how, CASE WHEN record_id = first THEN 'new' ELSE 'application_url' END) AS merged_by FROM n""")
def canonical_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Customers as incoming records against suppliers as linked ones; records that match nothing share URLs only."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    never = F.lit(None).cast("long")
    linked = t(spark, d, "supplier").where("s_suppkey % 5 > 0").select(s.alias("record_id"), (s % 50).alias("canonical_id"), F.concat(F.lit("u"), (s % 40).cast("string")).alias("url"), F.col("s_nationkey").alias("company"), (s % 11).alias("posting"), (1000 - s).alias("active_from"), never.alias("active_to"))
    c = t(spark, d, "customer")
    had = c.where("c_custkey % 17 = 0").select((-k).alias("record_id"), F.lit(900).cast("long").alias("canonical_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("company"), never.alias("posting"), F.lit(0).cast("long").alias("active_from"), never.alias("active_to"))
    official = c.where("c_custkey % 10 = 0").select((-k).alias("record_id"), F.lit(901).cast("long").alias("canonical_id"))
    posting = F.when(k % 13 < 11, k % 13)
    records = c.select((-k).alias("record_id"), F.concat(F.lit("u"), (k % 60).cast("string")).alias("url"), F.col("c_nationkey").alias("company"), posting.alias("posting"))
    # what matches no open link keeps its URL as its only key, so that the SQL needs no closure
    known = linked.select("company", "posting").distinct().withColumn("_open", F.lit(True))
    records = records.join(F.broadcast(known), ["company", "posting"], "left").withColumn("posting", F.when(F.col("_open"), F.col("posting"))).drop("_open")
    return canonical.assign(records, linked.unionByName(had), official)


@query("MRG-06", "DML-08", oracle=f"""
    WITH l AS (SELECT o_orderkey AS record_id, o_custkey AS canonical_id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'primary' ELSE 'supporting' END AS role, o_orderdate::TIMESTAMP AS active_from FROM orders),
    x AS (SELECT *, record_id % 7 = 0 AS leaves FROM l), b AS (SELECT DISTINCT canonical_id FROM x WHERE leaves AND role = 'primary'),
    h AS (SELECT canonical_id, arg_min(record_id, (active_from, record_id)) AS record_id FROM x JOIN b USING (canonical_id) WHERE NOT leaves GROUP BY canonical_id)
    SELECT x.record_id, x.canonical_id, role, 'new_canonical' AS rule, active_from, CASE WHEN leaves OR h.record_id IS NOT NULL THEN greatest({_NOW}, active_from + INTERVAL 1 MICROSECOND) END AS active_to FROM x LEFT JOIN h ON h.record_id = x.record_id
    UNION ALL SELECT record_id, -record_id, 'primary', 'manual_unmerge', {_NOW}, NULL FROM x WHERE leaves UNION ALL SELECT record_id, canonical_id, 'primary', 'unmerge_primary_repair', {_NOW}, NULL FROM h""")
def unmerge_repair(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh order leaves its customer's canonical record; customers that lose the primary get the oldest other."""
    first = t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    role = F.when(F.col("o_orderkey") == F.col("first"), "primary").otherwise("supporting")
    links = t(spark, d, "orders").join(first, "o_custkey").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("canonical_id"), role.alias("role"), F.lit("new_canonical").alias("rule"), F.col("o_orderdate").cast("timestamp_ntz").alias("active_from"), F.lit(None).cast("timestamp_ntz").alias("active_to"))
    apart = t(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("record_id"), (-F.col("o_orderkey")).alias("new_canonical"))
    return canonical.unmerge(links, apart, F.lit("1998-09-01 00:00:00").cast("timestamp_ntz"))


@query("MRG-07", "PRO-15", oracle="""
    WITH x AS (SELECT DISTINCT o_custkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders), h AS (SELECT *, sha256('{"priority":"' || priority || '","status":"' || status || '"}') AS content_hash FROM x)
    SELECT o_custkey, content_hash FROM h WHERE NOT (o_custkey % 2 = 0 AND status = 'F')""")
def versions_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Versions that customers of even number do not have yet, who had all their orders of status F before."""
    current = t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    empty = spark.createDataFrame([], "o_custkey long, content_hash string")
    had = canonical.new_versions(empty, current.where("o_custkey % 2 = 0 and status = 'F'"), "o_custkey", ["status", "priority"])
    return canonical.new_versions(had, current, "o_custkey", ["status", "priority"]).select("o_custkey", "content_hash")


@query("MRG-10", oracle="""
    WITH x AS (SELECT o_orderkey, 'employment' AS field, CASE o_orderkey % 3 WHEN 0 THEN 'not_parsed' WHEN 1 THEN 'low_confidence' END AS reason FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 'locations', 'not_mentioned' FROM orders WHERE o_orderkey % 5 = 0),
    y AS (SELECT *, sha256('{"extractionId":"' || o_orderkey || '","field":"' || field || '","reason":"' || reason || '","source":"deterministic_readiness"}') AS idempotency_key FROM x)
    SELECT * FROM y WHERE NOT (field = 'locations' AND o_orderkey % 2 = 0)""")
def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of unknown and conflicting facts, without those that exist: places of even orders."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    employment = facts.single_fact(F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))), "not_parsed")
    places = facts.fact(F.when(k % 5 == 0, none).otherwise(F.array(F.lit("JP"))), "not_mentioned")
    told = t(spark, d, "orders").select("o_orderkey", employment.alias("employment"), places.alias("locations"))
    nothing = spark.createDataFrame([], "idempotency_key string")
    had = canonical.review_tasks(told.where("o_orderkey % 2 = 0"), "o_orderkey", ["locations"], nothing)
    return canonical.review_tasks(told, "o_orderkey", ["employment", "locations"], had)


@query("MRG-11", oracle="""
    WITH x AS (SELECT p_partkey, [p_brand, p_type] AS v, CASE WHEN p_size % 2 = 0 THEN ['e1'] ELSE ['e1', 'e2'] END AS e FROM part)
    SELECT p_partkey, 'kind' AS field, i AS ordinal, v[i + 1] AS value, coalesce(e[i + 1], e[1]) AS evidence FROM x, (SELECT unnest([0, 1]) AS i)""")
def fact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A row for each value with the evidence of its place, else the first."""
    kind = facts.fact(F.array("p_brand", "p_type"))
    evidence = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("e1"))).otherwise(F.array(F.lit("e1"), F.lit("e2")))
    return facts.evidence_rows(t(spark, d, "part").select("p_partkey", kind.alias("kind"), evidence.alias("evidence")), "p_partkey", "kind", "evidence")


@query("PRJ-03", oracle="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'published' ELSE 'first_seen' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT08:30:00.000Z') ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') END AS value FROM orders""")
def date_display(spark: SparkSession, d: str) -> DataFrame:
    """The date to show: published if its precision and value are known, else when it was first seen."""
    k, on = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    precision = F.when(k % 3 == 0, "date").when(k % 3 == 1, "datetime")
    shown = facts.display_date(precision, F.when(k % 3 == 0, F.date_format(on, "yyyy-MM-dd")), F.when(k % 3 == 1, on + F.expr("interval 8 hours 30 minutes")), on)
    return t(spark, d, "orders").select("o_orderkey", shown["kind"].alias("kind"), shown["value"].alias("value"))


@query("DML-05", oracle="""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 6 = 0 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def patched_rows(spark: SparkSession, d: str) -> DataFrame:
    """A partial update: what a change leaves null stays."""
    old = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = t(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.when(F.col("s_suppkey") % 6 == 0, F.lit(0.5)).alias("s_acctbal"))
    return tables.patch(old, changes, ["s_suppkey"])


@query("DML-06", oracle="""
    SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 OR c_acctbal > 0""")
def guarded_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are there, and new ones that pass the guard and whose key is not there."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.insert_where(c.where("c_custkey % 2 = 0"), c, ["c_custkey"], F.col("c_acctbal") > 0).select("c_custkey", "c_name")


@query("DML-11", oracle="""
    SELECT event_id FROM events WHERE event_id % 3 <> 0 GROUP BY event_id""")
def events_for_consumer(spark: SparkSession, d: str) -> DataFrame:
    """Events that a consumer has not had; other consumers' progress does not matter."""
    e = t(spark, d, "events").select("event_id")
    processed = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "mine").otherwise("theirs").alias("consumer"))
    return tables.once_per_consumer(e, processed, "mine")


@query("SNK-03", oracle="""SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1""")
def published_version(spark: SparkSession, d: str) -> DataFrame:
    """A table published twice in the shared folder: a reader sees the second version, whole."""
    root = scratch(spark, "published")
    nations = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    tables.publish(nations.where("n_nationkey % 2 = 0"), root)
    tables.publish(nations, root)
    return tables.current(spark, root).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("MRG-04", oracle="""
    WITH RECURSIVE l AS (SELECT s_suppkey AS record_id, 's' || (s_suppkey % 50) AS canonical_id, 'u' || (s_suppkey % 40) AS url, s_nationkey AS company, s_suppkey % 11 AS posting, 1000 - s_suppkey AS active_from FROM supplier WHERE s_suppkey % 5 > 0),
    r AS (SELECT 1000000 + c_custkey AS record_id, CASE WHEN c_custkey % 9 > 0 THEN 'u' || (c_custkey % 240) END AS url, c_nationkey AS company, CASE WHEN c_custkey % 13 < 11 THEN c_custkey % 97 END AS posting, c_custkey % 17 = 0 AS had, c_custkey % 10 = 0 AS linked FROM customer),
    u AS (SELECT url, arg_min(canonical_id, (active_from, record_id)) AS uc FROM l GROUP BY url), p AS (SELECT company, posting, arg_min(canonical_id, (active_from, record_id)) AS pc FROM l GROUP BY ALL),
    m AS (SELECT r.*, uc, pc, CASE WHEN url IS NOT NULL THEN min(record_id) FILTER (NOT had) OVER (PARTITION BY url) END AS fu, CASE WHEN posting IS NOT NULL THEN min(record_id) FILTER (NOT had) OVER (PARTITION BY company, posting) END AS fp FROM r LEFT JOIN u USING (url) LEFT JOIN p USING (company, posting)),
    w AS (SELECT record_id, CASE WHEN had THEN 'c900' WHEN linked THEN 'c901' WHEN uc IS NOT NULL THEN uc WHEN fu < record_id THEN NULL ELSE pc END AS fixed, CASE WHEN had THEN 'existing_source' WHEN linked THEN 'official_link' WHEN uc IS NOT NULL OR fu < record_id THEN 'application_url' WHEN pc IS NOT NULL OR fp < record_id THEN 'posting_id' ELSE 'new' END AS merged_by,
        CASE WHEN fu < record_id THEN fu WHEN fp < record_id THEN fp END AS up FROM m),
    c AS (SELECT record_id, coalesce(fixed, 'new-' || record_id) AS canonical_id, merged_by FROM w WHERE fixed IS NOT NULL OR up IS NULL UNION ALL SELECT w.record_id, c.canonical_id, w.merged_by FROM w JOIN c ON w.up = c.record_id WHERE w.fixed IS NULL AND w.up IS NOT NULL)
    SELECT * FROM c""")
def arrival_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records that come one by one, in the order of their numbers, against suppliers as linked ones; postings join what URLs do not."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    linked = t(spark, d, "supplier").where("s_suppkey % 5 > 0").select(s.alias("record_id"), text("s", s % 50).alias("canonical_id"), text("u", s % 40).alias("url"), F.col("s_nationkey").alias("company"), (s % 11).alias("posting"), (1000 - s).alias("active_from"), F.lit(None).cast("long").alias("active_to"))
    c = t(spark, d, "customer")
    had = c.where("c_custkey % 17 = 0").select((1_000_000 + k).alias("record_id"), F.lit("c900").alias("canonical_id"), *[F.lit(None).cast(kind).alias(n) for n, kind in (("url", "string"), ("company", "int"), ("posting", "long"))], F.lit(0).cast("long").alias("active_from"), F.lit(None).cast("long").alias("active_to"))
    official = c.where("c_custkey % 10 = 0").select((1_000_000 + k).alias("record_id"), F.lit("c901").alias("canonical_id"))
    records = c.select((1_000_000 + k).alias("record_id"), F.when(k % 9 > 0, text("u", k % 240)).alias("url"), F.col("c_nationkey").alias("company"), F.when(k % 13 < 11, k % 97).alias("posting"))
    return canonical.assign_in_order(records, linked.unionByName(had), official)


@query("JOI-12", "MRG-04", oracle="""
    WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_nationkey || ':' || (s_suppkey % 7) AS a, (s_acctbal / 500)::INT || ':' || (s_suppkey % 3) AS b FROM supplier), e AS (SELECT DISTINCT x.id AS i, y.id AS j FROM n x JOIN n y ON x.a = y.a OR x.b = y.b),
    r AS (SELECT id, id AS root FROM n UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id) SELECT id, min(root) AS entity FROM r GROUP BY id""")
def entities_by_batches(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that come in three batches, later ones joining entities of the earlier."""
    store = entities.Identities(spark, scratch(spark, "identities"), buckets=16)
    n = t(spark, d, "supplier").select("s_suppkey", F.concat_ws(":", "s_nationkey", (F.col("s_suppkey") % 7)).alias("a"), F.concat_ws(":", F.round(F.col("s_acctbal") / 500).cast("int"), (F.col("s_suppkey") % 3)).alias("b"))
    for i in range(3):
        store.add(n.where(F.col("s_suppkey") % 3 == i), "s_suppkey", ["a", "b"])
    return store.entities()
