"""Importance resampling towards a target distribution over hashed features.

Features are runs of one to three consecutive words, hashed into buckets by the
CRC-32 of their bytes. What the corpus and the target hold in each bucket gives
the bucket's gain, and the gains stand in one array of fixed size that scores
each document in numpy. The gain of a document plus Gumbel noise is its score;
the highest scores are a weighted sample without replacement.

The k-th key in the order of score (falling) and doc_id is found by a radix
selection: each round counts one digit of the keys that agree with the digits
chosen so far, in as many counters as a digit has values, and no more than that
ever reaches the driver. Keys end with the row's number, so they are distinct.
Only the rows up to the k-th key are range-sorted and ranked.

A CRC of a run of words is composed from those of its words: shifting a CRC over
n bytes is linear, so tables by byte value give it for whole arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_slices, give_back, plain_words, received, send, shuffle_partitions, written

BUCKETS = 10_000
#: Bits of a digit of the radix selection.
DIGIT = 16
#: Bytes that one table shifts a CRC over at most; more are done by steps.
REACH = 255
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
LAST = (1 << 63) - 1


def shift_tables(reach: int = REACH) -> np.ndarray:
    """[n, place, byte]: what a byte at a place of a CRC becomes over n bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, np.uint32(POLYNOMIAL) ^ (one >> 1), one >> 1)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])
    out = [now]
    for _ in range(reach):
        now = one[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


def shifted(crc: np.ndarray, over: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC, shifted over so many bytes."""
    crc, over = crc.copy(), over.astype(np.int64)
    rest = np.arange(len(crc))
    while len(rest):
        n, c = np.minimum(over[rest], REACH), crc[rest]
        crc[rest] = tables[n, 0, c & 255] ^ tables[n, 1, (c >> 8) & 255] ^ tables[n, 2, (c >> 16) & 255] ^ tables[n, 3, c >> 24]
        over[rest] -= n
        rest = rest[over[rest] > 0]
    return crc


def features(texts: list[bytes | None], tables: np.ndarray, runs: int = 3) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each run length the texts of its features and their CRCs."""
    split = [plain_words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(split)), counts)
    spaced = shifted(np.full(len(own), zlib.crc32(b" "), np.uint32), size, tables) ^ own
    crc, out = own, []
    for n in range(1, runs + 1):
        if n > 1:
            crc = shifted(crc[: max(0, len(own) - n + 1)], size[n - 1 :] + 1, tables) ^ spaced[n - 1 :]
        same = of[: len(crc)] == of[n - 1 :]
        out.append((of[: len(crc)][same], crc[same]))
    return counts, out


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row a bucket at most."""
    tables = send(texts.sparkSession, shift_tables())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = received(tables), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in byte_slices(batch.column("text")):
                for _, crc in features(part, known)[1]:
                    held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])
        give_back()

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source, in doubles."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times) a standard Gumbel variable of the doc_id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """row (its number), doc_id, n_words, n_features, weight and score of each document, written."""
    sent = send(docs.sparkSession, (shift_tables(), gain))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, gain = received(sent)
        for batch in batches:
            for a, b, part in byte_slices(batch.column("text")):
                counts, found = features(part, tables)
                weight, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for of, crc in found:
                    ends = np.cumsum(np.r_[0, np.bincount(of, minlength=len(part))])
                    sums = np.cumsum(np.r_[0, gain[crc % np.uint32(len(gain))]])
                    weight += sums[ends[1:]] - sums[ends[:-1]]
                    n += np.diff(ends)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts, n, weight))], ["row", "doc_id", "n_words", "n_features", "weight"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, n_features long, weight long")
    return written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")


def kth_key(rows: DataFrame, k: int, keys: tuple[str, ...]) -> tuple | None:
    """The k-th smallest tuple of long columns that hold no null and are distinct together; None if there are fewer than k, or k is 0.

    Leading digits that all keys share are left out by the columns' extremes.
    """
    ends = rows.agg(F.count(F.lit(1)), *[f(c) for c in keys for f in (F.min, F.max)]).first()
    if not 0 < k <= ends[0]:
        return None
    same, left = F.lit(True), k
    for i, c in enumerate(keys):
        low, high = ends[1 + 2 * i], ends[2 + 2 * i]
        bits = ((low ^ high) & ((1 << 64) - 1)).bit_length()
        for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-1 << 63)), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = sorted((r.d, r.n) for r in rows.where(same).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
            for value, n in counts:
                if left <= n:
                    break
                left -= n
            same &= digit == value
            if left == n:
                return tuple(rows.where(same).agg(F.max(F.struct(*keys)).alias("x")).first().x)
    return tuple(rows.where(same).agg(F.max(F.struct(*keys)).alias("x")).first().x)


def ranked(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with rank from 1 by the keys: range-partitioned, numbered in each range, plus the sizes of the ranges before, one number a range."""
    part = written(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "drawn")
    sizes, before = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect(), 0
    starts = []
    for p, n in sorted(tuple(r) for r in sizes):
        starts.append((p, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return part.join(start, "_part").withColumn("rank", F.col("_start") + F.col("_i") + 1).drop("_part", "_i", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (all long but the id) of each document; rank is null where it isn't drawn.

    docs has doc_id and text, target text; other columns end here, whatever their names. A text's words are runs of
    letters, digits and characters beyond ASCII, A-Z lower-cased; texts are taken whole, however long. A null or
    empty text has no features and weight 0, and a score by its noise. Of the documents of at least least_words
    words, floor(percent / 100 of them) are drawn: the highest scores, ties to the smaller doc_id. Rows with
    equal doc_ids are separate rows with equal noise, and tie further by their order of reading. A null doc_id
    has the noise of an empty one and stands last among ties. doc_id is a whole number. An empty table gives an empty table; an empty target gives every bucket the same count.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scores = weighted(docs, gain, seed)
    keyed = scores.where(F.col("n_words") >= least_words).select("*", F.bitwise_not("score").alias("_by"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"))
    keys = ("_by", "_id", "row")
    last = kth_key(keyed, keyed.count() * percent // 100, keys)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = F.struct(*keys) <= F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(keys, last, strict=True)])
    chosen = ranked(keyed.where(drawn), keys).select(*columns, "rank")
    others = scores.where(F.col("n_words") < least_words).select(*columns).unionAll(keyed.where(~drawn).select(*columns))
    return chosen.unionAll(others.withColumn("rank", F.lit(None).cast("long")))
