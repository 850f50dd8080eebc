"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source gets a share of all words by weight, at most `most` times its own
size. Its documents are read in a fixed random order, whole rounds first; the
last round stops at the target. Source i's weight may change over training
time t in [0, 1]: its schedule is the line from `start` to `end`, whose
integral is the cumulative demand; inverting that integral at a document's
cumulative words gives its training position, by which documents are
range-sorted.

The cumulative words of a hot source never meet in one task: the random order,
by a hash of id and text, is cut into hash ranges, the words of each range are
summed first, and each range adds its own prefix to the sum of those before it.
One row a source meets in one task, where the targets are shared out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, packed, unpacked

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Slope of the schedules by the same order: rising, level, falling.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """sizes (_source, source_size) with weight, start, end and target.

    One row a source meets in one task here, as the ranks by name need; sources are few beside documents.
    With sources in order of the ratio of limit to weight, a prefix is at its limit; the level that
    shares what is left by weight is the largest of the levels after each prefix.
    """
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))
    order = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    limit = F.lit(float(most)) * F.col("source_size")
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("_source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("_i", order)
        .withColumn("weight", pick(weights, F.col("_i")))
        .withColumn("start", pick([a for a, _ in SCHEDULES], F.col("_i")))
        .withColumn("end", pick([b for _, b in SCHEDULES], F.col("_i")))
        .withColumn("_limit", limit)
        .withColumn("_level", (F.sum("source_size").over(whole) - before) / after)
        .withColumn("target", F.least(F.max("_level").over(whole) * F.col("weight"), F.col("_limit")))
        .drop("_i", "_limit", "_level")
    )


def position(done: Column, start: Column, end: Column) -> Column:
    """Training time at which a source's demand, the integral of its schedule, reaches the fraction done."""
    area = done * (start + end) / 2
    return F.when(start == end, done).otherwise((F.sqrt(start * start + 2 * (end - start) * area) - start) / (end - start))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0, rows_per_range: int = 2000, columns: Sequence[str] | None = None) -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted), first_position, words_before (of its source, in a round), start and end (of its source's weight).

    A null text has size 0 and is not taken, nor is an empty one; a null source is a source, last in order. Rows
    with equal or null doc_ids are separate rows; equal rows are alike, so their order does not matter. Whole rounds
    take every document; the round that ends at the target takes whole documents in the order of
    MD5(doc_id|text) and part of the one at the boundary. All columns of docs are kept, or those asked for, whatever
    their names, but those named like the new ones are replaced. An empty table gives an empty table.
    """
    digits = min(6, max(1, math.ceil(math.log(max(1, docs.count()) / rows_per_range, 16))))
    source, text = F.col("source").cast("string"), F.coalesce("text", F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    sized = packed(docs, words(F.col("text")).alias("size"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), order.alias("order"), columns=columns).withColumn("range", F.substring("order", 1, digits))
    sums = sized.groupBy("key", "range").agg(F.sum("size").alias("words"), F.first("source").alias("_source"))
    aims = targets(sums.groupBy("key").agg(F.first("_source").alias("_source"), F.sum("words").alias("source_size")), weights, most).drop("_source")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words", "_source").join(aims, "key")
    inside = Window.partitionBy("key", "range").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("source_size") > 0
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    mixed = (
        sized.join(ranges, ["key", "range"])
        .withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rounds", F.when(known, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.floor(F.col("target") - F.col("rounds") * F.col("source_size")))
        .withColumn("taken", taken)
        .withColumn("at", F.when(F.col("taken") > 0, position(F.col("before") / F.col("target"), F.col("start"), F.col("end"))))
    )
    own = {c: F.col(c) for c in ("size", "source_size", "target", "taken", "start", "end")}
    return unpacked(mixed, docs.columns if columns is None else list(columns), **own, first_position=F.col("at"), words_before=F.col("before"))


def _range_sorted(rows: DataFrame, partitions: int | None, *keys: Column | str) -> DataFrame:
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def by_position(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of mix, range-sorted by the position at which training first reads each document; those it never reads come last."""
    return _range_sorted(mixed, partitions, F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each copy of a document that the mix takes, range-sorted by position, with copy int and position double.

    Copies are taken / size, rounded: the last, partial one counts if it is half a document or more. A later copy
    stands whole rounds of its source further on. Documents without words have no copies; null ids come last
    among equal positions; columns named copy or position are replaced. An empty table gives an empty table.
    """
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    done = lambda i: F.least(F.lit(1.0), (F.col("words_before") + i * F.col("source_size")) / F.col("target"))
    rows = packed(mixed, *[F.col(c) for c in ("source_size", "target", "words_before", "start", "end")], F.col("doc_id").alias("id"), copies.alias("n")).where("n > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", position(done(F.col("i")), F.col("start"), F.col("end")))
    return unpacked(_range_sorted(rows, partitions, F.col("at"), F.col("id").asc_nulls_last(), F.col("i")), mixed.columns, copy=F.col("i"), position=F.col("at"))
