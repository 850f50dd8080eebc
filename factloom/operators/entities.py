"""Records that are one entity: components over shared keys, of a whole table or kept batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.combine import looked_up
from factloom.operators.ranking import kept
from factloom.operators.tables import current, publish


def key_pairs(records: DataFrame, id_: str, keys: Sequence[str]) -> DataFrame:
    """id_, k (the key's name) and v (its value as text) of every key that is not null."""
    each = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v"))) for k in keys]))
    return records.select(id_, F.explode(each).alias("x")).select(id_, "x.k", "x.v")


def connected(pairs: DataFrame, labels: DataFrame, id_: str) -> DataFrame:
    """labels (id_, entity, which begins as the id) with the smallest id that is reached over shared pairs (id_, k, v).

    A record and a key value are the two sides of a bipartite graph; each round every value takes the smallest label of
    its records, every record that of its values, and then the label of that label, so that rounds grow with the
    logarithm of a chain. Values of more records than a task's share, fewer than there are tasks, come back by a
    broadcast, so no shared value is a hot join key.
    """
    pairs = kept(pairs)
    share = pairs.count() / int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = kept(pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("k", "v", F.lit(True).alias("hot")))
    marked = kept(pairs.join(F.broadcast(hot), ["k", "v"], "left"))
    while True:
        at_value = marked.join(labels, id_).groupBy("k", "v", "hot").agg(F.min("entity").alias("low"))
        few = marked.where("hot").join(F.broadcast(at_value.where("hot").select("k", "v", "low")), ["k", "v"])
        rest = marked.where("hot is null").join(at_value.where("hot is null").select("k", "v", "low"), ["k", "v"])
        new = few.select(id_, "low").union(rest.select(id_, "low")).groupBy(id_).agg(F.min("low").alias("low"))
        stepped = labels.join(new, id_, "left").select(id_, F.col("entity").alias("was"), F.coalesce(F.least("entity", "low"), "entity").alias("entity"))
        further = labels.select(F.col(id_).alias("entity"), F.col("entity").alias("beyond"))
        moved = kept(stepped.join(further, "entity", "left").select(id_, "was", F.least("entity", "beyond").alias("entity")))
        labels = moved.select(id_, "entity")
        if not moved.where("entity < was").limit(1).count():
            return labels


def resolve(records: DataFrame, id_: str, keys: Sequence[str]) -> DataFrame:
    """records with entity: the smallest id that is reached over shared key values. Null keys join nothing."""
    labels = records.select(id_, F.col(id_).alias("entity"))
    return records.join(connected(key_pairs(records, id_, keys), labels, id_), id_)


class Identities:
    """Entities that are kept batch by batch: the label of every key value, and a log of labels that have become others.

    A batch joins its own keys with the stored ones of the buckets that it meets, takes the components of what is new
    and of the labels met, appends the key values that are new, and rewrites the log, which has a row for each label
    that is no entity any more. No edge of an earlier batch is read or kept. An id is a key value of its own, so that a
    record may come again with other keys. What a batch wrote counts once the log's new version is published, so a
    batch that fails leaves nothing behind, and one that runs again gives the same. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _log(self) -> DataFrame:
        """old, new: labels that others replaced; and a row for each batch that counts, with its folder in `part`."""
        try:
            return current(self.spark, f"{self.root}/log")
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "old long, new long, part string")

    def _keys(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """k, v, label as it was stored; of some buckets only their folders are read."""
        parts = [r.part for r in self._log().where("part is not null").select("part").collect()]
        if not parts:
            return self.spark.createDataFrame([], "k string, v string, label long, bucket int")
        rows = self.spark.read.option("basePath", f"{self.root}/keys").schema("k string, v string, label long, part string, bucket int").parquet(*[f"{self.root}/keys/part={p}" for p in parts]).drop("part")
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def _now(self, rows: DataFrame) -> DataFrame:
        """rows with label as it is now; a label's log row is found by a join, and hot labels by a broadcast."""
        became = self._log().where("old is not null").select(F.col("old").alias("label"), "new")
        return looked_up(rows, became, ["label"]).withColumn("label", F.coalesce("new", "label")).drop("new")

    def add(self, records: DataFrame, id_: str, keys: Sequence[str]) -> None:
        """Takes a batch: records with a whole number as id and some keys, of which nulls join nothing."""
        ids = records.select(F.col(id_).cast("long").alias("id"), *keys)
        own = key_pairs(ids, "id", keys).unionAll(ids.select("id", F.lit("").alias("k"), F.col("id").cast("string").alias("v"))).distinct()
        pairs = kept(own.withColumn("bucket", F.pmod(F.xxhash64("k", "v"), F.lit(self.buckets)).cast("int")))
        met = [r.bucket for r in pairs.select("bucket").distinct().collect()]
        values = pairs.select("k", "v").distinct()
        old = kept(self._now(self._keys(met).drop("bucket").join(values, ["k", "v"], "left_semi")))
        graph = pairs.select("id", "k", "v").unionAll(old.select(F.col("label").alias("id"), "k", "v"))
        found = kept(connected(graph, graph.select("id").distinct().withColumn("entity", F.col("id")), "id"))
        became = kept(old.select(F.col("label").alias("id")).distinct().join(found.where("entity < id"), "id").select(F.col("id").alias("old"), F.col("entity").alias("new")))
        fresh = pairs.join(old.select("k", "v"), ["k", "v"], "left_anti").groupBy("k", "v", "bucket").agg(F.min("id").alias("id")).join(found, "id")
        part = uuid.uuid4().hex
        fresh.select("k", "v", F.col("entity").alias("label"), "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/keys/part={part}")
        log = self._log()
        later = became.select(F.col("old").alias("new"), F.col("new").alias("latest"))
        merged = looked_up(log.where("old is not null").select("old", "new"), later, ["new"]).select("old", F.coalesce("latest", "new").alias("new")).unionByName(became)
        batches = log.where("part is not null").select("part").union(self.spark.createDataFrame([(part,)], "part string"))
        publish(merged.withColumn("part", F.lit(None).cast("string")).unionByName(batches.select(F.lit(None).cast("long").alias("old"), F.lit(None).cast("long").alias("new"), "part")), f"{self.root}/log")

    def entities(self) -> DataFrame:
        """id and entity of every record so far."""
        return self._now(self._keys().where("k = ''").select(F.col("v").cast("long").alias("id"), "label")).select("id", F.col("label").alias("entity"))
