"""Top-one, paging, claims and interleaving: everything that orders rows."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import scratch


def top_one(df: DataFrame, keys: Sequence[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def encode_cursor(**values: object) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not isinstance(values, dict):
        raise ValueError("not a cursor")
    return values


def keyset_page(df: DataFrame, time: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next `size` (1 to 200) rows by time and key, both falling, after the given last row."""
    if not 1 <= size <= 200:
        raise ValueError("a page has 1 to 200 rows")
    if after is not None:
        at, last = F.lit(after[0]).cast(df.schema[time].dataType), F.lit(after[1])
        df = df.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < last)))
    return df.orderBy(F.desc(time), F.desc(key)).limit(size)


def weighted_claim(queue: DataFrame, lane: str, shares: dict[str, float], limit: int, order: Sequence[str]) -> DataFrame:
    """`limit` rows: each lane its share in order, and what lanes leave free goes to the first of the other rows.

    The smallest share gets what rounding leaves.
    """
    names = list(shares)
    quotas = {n: int(limit * shares[n]) for n in names}
    quotas[names[-1]] += limit - sum(quotas.values())
    quota = F.coalesce(*[F.when(F.col(lane) == n, F.lit(q)) for n, q in quotas.items()], F.lit(0))
    within = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    # no lane can be asked for more than `limit` rows, so only those go on to the single ordered task
    ranked = queue.where(F.col(lane).isin(names)).withColumn("_in_lane", within).where(F.col("_in_lane") <= limit).withColumn("_own", F.col("_in_lane") <= quota)
    overall = F.row_number().over(Window.orderBy(F.desc("_own"), *order))
    return ranked.withColumn("_n", overall).where(F.col("_n") <= limit).withColumn("borrowed", ~F.col("_own")).drop("_in_lane", "_own", "_n")


def fair_interleave(df: DataFrame, lane: str, weights: dict[str, float], cost: str, order: Sequence[Column | str]) -> DataFrame:
    """df with due: how far along a row's turn is when the lane with the least consumed cost per weight goes next.

    A row is due when its lane has consumed what stands before it, so sorting by that prefix over the
    weight gives the order that picking one at a time gives; `place_by_due` numbers the rows so.
    """
    weight = F.coalesce(*[F.when(F.col(lane) == n, F.lit(float(w))) for n, w in weights.items()])
    return running_before(df, lane, cost, order, "_before").withColumn("due", F.col("_before") / weight).drop("_before")


def place_by_due(due: DataFrame, lane: str, weights: dict[str, float], order: Sequence[Column | str]) -> DataFrame:
    """The rows of fair_interleave with their position (from 1); of rows due together, lanes go in the order of weights."""
    turn = F.coalesce(*[F.when(F.col(lane) == n, F.lit(i)) for i, n in enumerate(weights)], F.lit(len(weights)))
    return global_rank(due, F.col("due"), turn, *[F.col(o) if isinstance(o, str) else o for o in order], name="position")


def running_before(df: DataFrame, key: str, value: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with the sum of value over the rows of its key that come before, however many rows a key has.

    Rows are range-partitioned by key and order; each range adds its own prefix to the sum of the key's ranges before
    it, of which there are no more than ranges and keys together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = kept(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(key, "_part").agg(F.sum(value).alias("_sum")).select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = part.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return held.join(sums, (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_at", "_key", "_base", "_own")


def greedy_interleave(items: Iterator[tuple[str, float]], weights: dict[str, float]) -> list[int]:
    """The same order by picking one row at a time; for tests and small lists."""
    lanes: dict[str, list[tuple[int, float]]] = {n: [] for n in weights}
    for i, (lane, cost) in enumerate(items):
        lanes[lane].append((i, cost))
    used, out = dict.fromkeys(weights, 0.0), []
    while any(lanes.values()):
        lane = min((n for n in weights if lanes[n]), key=lambda n: (used[n] / weights[n], list(weights).index(n)))
        i, cost = lanes[lane].pop(0)
        used[lane] += cost
        out.append(i)
    return out


def quota_per_kind(df: DataFrame, kind: str, kinds: Sequence[str], most: int, order: Sequence[str]) -> DataFrame:
    """The first ceil(most / kinds) rows of each kind, kinds in the order given, `most` rows together; no borrowing."""
    per = -(-most // len(kinds))
    place = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(kinds)])
    few = top_one(df.where(F.col(kind).isin(list(kinds))), [kind], *order, k=per)
    return few.orderBy(place, *order).limit(most)


def global_rank(df: DataFrame, *order: Column, partitions: int | None = None, name: str = "rank") -> DataFrame:
    """df with each row's place (from 1, long) in one order of all rows, without sorting them in one task.

    Rows are kept (the range partitioning reads them twice, to sample and to deal), range-partitioned by the order and
    kept again; each partition numbers its own rows and adds the rows of the partitions before it, one number a partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = kept(kept(df).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_i", inside).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def kept(df: DataFrame) -> DataFrame:
    """Cut off from its lineage by a checkpoint in the shared folder."""
    scratch(df.sparkSession, "")
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: smaller than a checkpoint, and its size is known to later joins."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_by_score(df: DataFrame, score: str, title: str, key: str, collation: str = "UNICODE") -> DataFrame:
    """rank from 1: score falling, title by collation, key."""
    return global_rank(df, F.desc(score), F.collate(F.col(title), collation), F.col(key))


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """n, p50 and p95 by place in the sorted values (from 0): floor(n * 0.5) and ceil(n * 0.95) - 1."""
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(value), F.col(value))
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    at = lambda place: F.max(F.when(F.col("rank") == place + 1, F.col(value)))
    return ranked.join(F.broadcast(total)).groupBy("n").agg(at(F.floor(F.col("n") * 0.5)).alias("p50"), at(F.ceil(F.col("n") * 0.95) - 1).alias("p95"))
