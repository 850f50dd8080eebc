"""Table changes as functions from old rows and changes to new rows, as built-in file tables have no MERGE."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.ranking import kept
from factloom.session import scratch


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new (one a key) whose key old does not have."""
    fresh = new.dropDuplicates(list(keys))
    return old.unionByName(fresh.join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys, new values where there are any, and action: kept, inserted or updated."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("_old", F.lit(True)), new.withColumnsRenamed({c: f"_new_{c}" for c in values}).withColumn("_new", F.lit(True))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    return a.join(b, list(keys), "full").select(*keys, *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values], action.alias("action"))


def patch(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the non-null values of changes; a null keeps what is there."""
    values = [c for c in changes.columns if c not in keys]
    b = changes.withColumnsRenamed({c: f"_new_{c}" for c in values})
    return old.join(b, list(keys), "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def monotone_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Full merge by rule: greatest, least, first (old value unless null), last (new unless null), or (booleans), union (arrays), map (keys of both, new values)."""
    values = [c for c in old.columns if c not in keys]
    how = {
        "greatest": lambda a, b: F.greatest(a, b), "least": lambda a, b: F.least(a, b), "first": lambda a, b: F.coalesce(a, b), "last": lambda a, b: F.coalesce(b, a),
        "or": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), "union": lambda a, b: F.array_union(F.coalesce(a, b), F.coalesce(b, a)),
        "map": lambda a, b: F.coalesce(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), b, a),
    }
    b = new.withColumnsRenamed({c: f"_new_{c}" for c in values})
    return old.join(b, list(keys), "full").select(*keys, *[how[rules.get(c, "last")](F.col(c), F.col(f"_new_{c}")).alias(c) for c in values])


def insert_where(old: DataFrame, new: DataFrame, keys: Sequence[str], guard: Column) -> DataFrame:
    return insert_if_absent(old, new.where(guard), keys)


def supersede(open_rows: DataFrame, new: DataFrame, keys: Sequence[str], now: Column, start: str = "active_from", end: str = "active_to") -> DataFrame:
    """Intervals with the open one of each changed key closed (a microsecond after its start at least) and the new one opened."""
    changed = new.select(*keys).distinct().withColumn("_changed", F.lit(True))
    closed_at = F.greatest(now, F.col(start) + F.expr("interval 1 microsecond"))
    closed = open_rows.join(changed, list(keys), "left").withColumn(end, F.when(F.col("_changed") & F.col(end).isNull(), closed_at).otherwise(F.col(end))).drop("_changed")
    return closed.unionByName(new.withColumn(start, now).withColumn(end, F.lit(None).cast(open_rows.schema[end].dataType)).select(*open_rows.columns))


def with_audit(table: DataFrame, targets: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, audit of the rows that go): what a chain of data-modifying statements does at once."""
    marked = table.withColumn("_gone", F.coalesce(targets, F.lit(False)))
    return marked.where("not _gone").drop("_gone"), marked.where("_gone").drop("_gone").withColumn("reason", F.lit(reason))


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (with its key column) without the rows of the keys in `gone` (column key); the order does not matter for rewrites."""
    return {name: df.join(gone.select(F.col("key").alias(k)).distinct(), k, "left_anti") for name, (df, k) in tables.items()}


def redact(df: DataFrame, gone: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with these columns nulled in the rows whose key is gone."""
    marked = df.join(gone.select(F.col("key").alias(key)).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def orphans(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Objects to delete: those that nothing refers to any more."""
    return objects.select(key).distinct().join(references.select(key), key, "left_anti")


def once_per_consumer(events: DataFrame, processed: DataFrame, consumer: str) -> DataFrame:
    """Events (event_id) that the consumer has not had."""
    had = processed.where(F.col("consumer") == consumer).select("event_id")
    return events.dropDuplicates(["event_id"]).join(had, "event_id", "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks (a null is no breach)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def exactly_one(*columns: str) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total == 1


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df as Parquet in the shared folder while it is read several times; the folder is removed at the end."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    try:
        df.write.option("compression", "zstd").parquet(at)
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _put_head(spark: SparkSession, root: str, text: str) -> None:
    """Replaces the head of a table in one rename."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    temp, head = path(f"{root}/.HEAD-{uuid.uuid4().hex}"), path(f"{root}/HEAD")
    out = fs.create(temp)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temp, head, options)


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version directory and points to it; a reader sees the old version or the new one, whole."""
    version = f"{root}/version={uuid.uuid4().hex}"
    df.write.parquet(version)
    _put_head(df.sparkSession, root, version)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a table of versions, or of a BucketTable."""
    head = spark.read.text(f"{root}/HEAD", wholetext=True).first()[0]
    if head.startswith("{"):
        return BucketTable.read_head(spark, json.loads(head))
    return spark.read.parquet(head)


class BucketTable:
    """A table dealt to buckets by its key, of which a change rewrites only those that it meets.

    The head names the folders of each bucket; it has at most `buckets` times `folders` entries and is replaced in one
    rename, so that readers see all of a change or nothing. Appends add a folder to the buckets they meet; a bucket of more
    than `folders` is put into one at its next change. One writer at a time; folders that no head names any more stay for readers of old heads.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 256, folders: int = 16):
        self.spark, self.root, self.keys, self.buckets, self.folders = spark, root, list(keys), buckets, folders

    def head(self) -> dict:
        try:
            return json.loads(self.spark.read.text(f"{self.root}/HEAD", wholetext=True).first()[0])
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {"schema": None, "buckets": {}}

    @staticmethod
    def read_head(spark: SparkSession, head: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(head["schema"])
        found = [f for b, folders in head["buckets"].items() if buckets is None or int(b) in buckets for f in folders]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    def rows(self) -> DataFrame | None:
        """All rows; None before the first change."""
        head = self.head()
        return self.read_head(self.spark, head) if head["schema"] else None

    def near(self, keys: DataFrame) -> DataFrame | None:
        """All rows of the buckets that these keys meet; None before the first change."""
        head = self.head()
        return self.read_head(self.spark, head, self._met(keys)) if head["schema"] else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of these keys, from their buckets alone."""
        rows = self.near(keys)
        return rows if rows is None else rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _met(self, rows: DataFrame) -> set[int]:
        return {r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Rows by bucket in a new folder: what was written where."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket())
        # a bucket is written by several tasks where there are fewer buckets than partitions
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.hash(*self.keys), F.lit(max(1, n // self.buckets)))
        dealt.repartition(n, "_bucket", part).write.partitionBy("_bucket").option("compression", "zstd").parquet(at)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(n.split("=")[1]): f"{at}/{n}" for n in names if n.startswith("_bucket=")}

    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Puts how(old, changes) in place of old, the rows of the buckets that changes meet; changes is kept, as it is read more than once."""
        changes, head = kept(changes), self.head()
        met = self._met(changes)
        schema = StructType.fromJson(head["schema"]) if head["schema"] else changes.schema
        old = self.read_head(self.spark, {"schema": json.loads(schema.json()), "buckets": head["buckets"]}, met)
        new = how(old, changes)
        written = self._write(new)
        stay = {b: f for b, f in head["buckets"].items() if int(b) not in met}
        _put_head(self.spark, self.root, json.dumps({"schema": json.loads(new.schema.json()), "buckets": stay | {str(b): [f] for b, f in written.items()}}))

    def append(self, rows: DataFrame) -> None:
        """Adds rows; a bucket that has too many folders is put into one."""
        head = self.head()
        written = self._write(rows)
        full = [b for b in written if len(head["buckets"].get(str(b), [])) >= self.folders]
        buckets = dict(head["buckets"])
        for b, f in written.items():
            buckets[str(b)] = [*buckets.get(str(b), []), f]
        head = {"schema": head["schema"] or json.loads(rows.schema.json()), "buckets": buckets}
        if full:
            whole = self._write(self.read_head(self.spark, head, full))
            head["buckets"] |= {str(b): [whole[b]] for b in full}
        _put_head(self.spark, self.root, json.dumps(head))


def append_once(store: BucketTable, rows: DataFrame, hash_: str) -> int:
    """Adds the rows whose key the store does not have and returns how many; a key that it has with another hash is drift, and an error.

    Nothing is added if anything drifts. Of equal keys in rows one is added; if their hashes differ, that is drift too.
    """
    with staged(rows, "rows") as rows:
        had = store.lookup(rows)
        both = rows.select(*store.keys, F.col(hash_).alias("_hash"))
        every = both if had is None else both.unionByName(had.select(*store.keys, F.col(hash_).alias("_hash")))
        drift = every.groupBy(*store.keys).agg(F.count_distinct("_hash").alias("n")).where("n > 1").drop("n").limit(5).collect()
        if drift:
            raise ValueError(f"drift: {', '.join(str(tuple(r)) for r in drift)} came with another {hash_}")
        new = rows.dropDuplicates(store.keys)
        new = new if had is None else new.join(had.select(*store.keys), store.keys, "left_anti")
        n = new.select(*store.keys).count()
        if n:
            store.append(new)
        return n
