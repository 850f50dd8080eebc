"""Exact line deduplication over a whole corpus, with DataFrame functions only.

Each line is keyed by the MD5 of its stripped, lower-cased form. The keys are
range-partitioned, with document and position as secondary sort keys, and a
window streams over each key's lines, knowing its first document. A key that a
sample shows among the most frequent, at most as many as there are partitions,
is cut into buckets of documents, each a range of its own; the first document
of all buckets of such a key comes from a small aggregate that is broadcast.
The sample decides only how rows are dealt: a key that it misses is streamed by
one task and gives the same result.

What leaves is no text: the lines to drop are gathered by document, and become
its keep bitmap as runs of kept lines, by which the text is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WHITE, ascii_lower, checkpointed, packed, shuffle_partitions, unpacked, written

#: A null doc_id counts as one document after all others.
LAST = (1 << 63) - 1
#: One document of so many is in the sample that tells frequent keys.
SAMPLE = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def kept_runs(dropped: Column, n: Column) -> Column:
    """Keep bitmap of n lines as runs (start, length) of kept ones, between the sorted dropped positions."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
    run = lambda i: F.struct(start(i).alias("start"), (F.coalesce(F.get(dropped, i), n) - start(i)).alias("length"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.size(dropped)), run), lambda r: r["length"] > 0)


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("h"), "doc", "row", "pos")


def duplicate_lines(docs: DataFrame, min_chars: int = 10, partitions: int | None = None) -> DataFrame:
    """Every line that an earlier document holds too: doc, row (a hash of its text), pos."""
    partitions = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    some = _keys(rows.where(F.pmod(F.xxhash64("doc", "row"), F.lit(SAMPLE)) == 0), min_chars)
    frequent = checkpointed(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(partitions).select("h", F.lit(True).alias("cut")))
    keyed = _keys(rows, min_chars).join(F.broadcast(frequent), "h", "left")
    bucket = F.when(F.col("cut"), F.pmod(F.xxhash64("doc"), F.lit(partitions)) + 1).otherwise(F.lit(0)).cast("int")
    ranged = keyed.select("h", bucket.alias("bucket"), "doc", "row", "pos").repartitionByRange(partitions, "h", "bucket")
    stream = Window.partitionBy("h", "bucket").orderBy("doc", "pos")
    held = written(ranged.withColumn("first", F.first("doc").over(stream)).where("bucket > 0 or doc > first"), "lines")
    carried = held.where("bucket > 0").groupBy("h").agg(F.min("first").alias("begun"))
    return held.join(F.broadcast(carried), "h", "left").where(F.col("doc") > F.coalesce("begun", "first")).select("doc", "row", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = 10, partitions: int | None = None) -> DataFrame:
    """docs with n_lines int, n_dropped int, keep_runs array<struct<start, length>> and kept_text.

    Lines are split at newline. A key of at least min_chars code points that
    several documents hold loses its lines in all but the smallest doc_id;
    repeats inside that document stay. A null or empty text is one empty line,
    a text is never cut short. Equal doc_ids are one document; rows with a null
    doc_id are one document after all others; repeated rows stay repeated. All
    columns of docs are kept, whatever their names, but those named like the
    four new ones are replaced. An empty table gives an empty table.
    """
    dropped = duplicate_lines(docs, min_chars, partitions).groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    rows = packed(docs, F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), F.col("text").alias("text"))
    joined = rows.join(dropped.hint("shuffle_hash"), ["doc", "row"], "left")
    lines = _lines(F.col("text"))
    cut = joined.withColumn("n", F.size(lines)).withColumn("runs", kept_runs(F.coalesce("dropped", F.array().cast("array<int>")), F.col("n")))
    kept = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    whole = (F.size("runs") == 1) & (F.get("runs", F.lit(0))["length"] == F.col("n"))
    n_kept = F.aggregate("runs", F.lit(0), lambda s, r: s + r["length"])
    return unpacked(cut, docs.columns, n_lines=F.col("n"), n_dropped=F.col("n") - n_kept, keep_runs=F.col("runs"), kept_text=F.when(whole, F.coalesce("text", F.lit(""))).otherwise(kept))
