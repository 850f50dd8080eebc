"""Benchmark decontamination by winnowing.

Texts are words, and every window of `window` consecutive words has a
fingerprint: the smallest hash of the k-grams in it. Neighbouring windows mostly
share theirs, so few are kept. Two equal windows have equal fingerprints, hence
every shared span of at least `window` words is met. An item of fewer words is
one window, and all lengths that such items have are winnowed in the same way,
each with a seed of its own.

Fingerprints of the items are gathered in a bitmap of bounded size, which the
documents' windows are held against where they are read; only those whose
fingerprint may be an item's leave the task. These are joined on the fingerprint
and, as the extension of the hit, on all words of the window around it, so that
what remains is exact and no group of equal fingerprints is ever paired off.
A hit leads to its items by way of the distinct lists of items that windows
have, and documents by way of the distinct sets of such lists, so that a passage
of many documents and many items isn't multiplied out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import byte_slices, give_back, joined, plain_words, received, send, written

#: Words of a k-gram.
K = 5
#: Bits of the bitmap for each fingerprint, and its least and largest size in bits (powers of two): at most 32 MB.
BITS, LEAST, MOST = 16, 20, 28
#: Multipliers of the polynomial over word hashes and of the mixing: odd 64-bit numbers.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

FOUND = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("text", pa.string())]))


def fingerprints(words: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The smallest k-gram hash of each window of n words, from the words' hashes; shorter windows have shorter grams."""
    k = min(k, n)
    grams = np.full(max(0, len(words) - k + 1), n, np.uint64)
    for i in range(k):
        grams = grams * STEP + words[i : i + len(grams)]
    for shift in (29, 32):
        grams = (grams ^ (grams >> np.uint64(shift))) * MIX
    least = grams[: max(0, len(words) - n + 1)].copy()
    for i in range(1, n - k + 1):
        np.minimum(least, grams[i : i + len(least)], out=least)
    return least


def windows_of(texts: list[bytes | None], lengths: list[int], bits: np.ndarray | None, whole: bool) -> tuple[list[int], list[tuple]]:
    """The number of words of each text, and (text, h, n, start, words) of windows whose fingerprint is in the bitmap, or of all.

    whole: a text of fewer words than the longest window is one window of all its words, and there are no others of its length.
    """
    split = [plain_words(t) for t in texts]
    counts = [len(w) for w in split]
    words = [w for ws in split for w in ws]
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    of = np.repeat(np.arange(len(split)), counts)
    first = np.cumsum([0, *counts])
    found: list[tuple] = []
    for n in range(1, max(lengths) + 1) if whole else lengths:
        h = fingerprints(hashes, n)
        ok = of[: len(h)] == of[n - 1 : n - 1 + len(h)]
        if whole and n < max(lengths):
            ok &= np.asarray(counts)[of[: len(h)]] == n
        if bits is not None:
            slot = h >> np.uint64(64 - int(math.log2(len(bits) * 8)))
            ok &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(ok)
        found += zip(of[at].tolist(), h[at].astype(np.int64).tolist(), [n] * len(at), (at - first[of[at]]).tolist(), [b" ".join(words[i : i + n]) for i in at.tolist()], strict=True)
    return counts, found


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item (the id as text, a null as an empty one), h, n, text: every window of the items, repeats included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in byte_slices(batch.column("text")):
                found = windows_of(texts, [window], None, True)[1]
                ids = batch.column("item").slice(a, b - a)
                columns = [ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[4].decode() for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "h", "n", "text"])
        give_back()

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, h long, n int, text string")


def bitmap(windows: DataFrame, prints: int) -> np.ndarray:
    """One bit for the leading bits of each fingerprint, gathered in blocks of 32,768 bits."""
    size = min(MOST, max(LEAST, math.ceil(math.log2(BITS * max(1, prints)))))
    slot = F.shiftrightunsigned("h", 64 - size) + 1
    blocks = windows.select(F.bitmap_bucket_number(slot).alias("block"), F.bitmap_bit_position(slot).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in blocks.collect():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.block - 1) * 4096 : (r.block - 1) * 4096 + len(part)] = part
    return out


def merged(hits: pd.Series) -> pd.Series:
    """The words that windows (start, n) cover, as runs that do not touch."""
    out = []
    for row in hits:
        at = np.array([(h["start"], h["start"] + h["n"]) for h in row], np.int64).reshape(-1, 2)
        at = at[np.argsort(at[:, 0], kind="stable")]
        reach = np.maximum.accumulate(at[:, 1])
        begins = np.flatnonzero(np.r_[True, at[1:, 0] > reach[:-1]])
        ends = reach[np.r_[begins[1:] - 1, len(at) - 1]]
        out.append([{"start": int(a), "length": int(b - a)} for a, b in zip(at[begins, 0], ends, strict=True)])
    return pd.Series(out)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words long, spans array<struct<start, length>> (of words, touching ones joined) and items array<string> of each document.

    docs has doc_id and text, items item_id and text; other columns end here, whatever their names. A text's words are
    runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A document word is in a span if it lies in an
    occurrence of `window` consecutive words of an item, or of all words of an item that has fewer. Texts are taken
    whole, however long. A null or empty text, or one without words, has no spans, and as an item finds nothing.
    Rows of docs with equal or null doc_ids are separate rows, and repeated rows get equal results. Item rows of
    one id are one item; a null item_id is an item named by the empty text. items holds distinct ids, sorted by code point. Either table may be empty.
    """
    spark = docs.sparkSession
    windows = written(item_windows(items, window), "item-windows")
    lists = windows.groupBy("h", "n", "text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = written(lists.withColumn("list", F.xxhash64("items")), "benchmark-windows")
    lengths = sorted(r.n for r in lists.select("n").distinct().collect())
    bits = send(spark, bitmap(lists, lists.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(bits)
        for batch in batches:
            for a, b, texts in byte_slices(batch.column("text")):
                counts, found = windows_of(texts, lengths, known, False) if lengths else ([len(plain_words(t)) for t in texts], [])
                found.sort(key=lambda f: f[0])
                offsets = np.searchsorted([f[0] for f in found], np.arange(len(texts) + 1))
                parts = [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4].decode() for f in found], pa.string())]
                each = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(FOUND.value_type)))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), pa.array(counts, pa.int64()), each], ["row", "doc_id", "n_words", "found"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    read = written(rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, found array<struct<h: long, n: int, start: int, text: string>>"), "documents-windows")
    seeds = written(read.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*"), "seeds")
    hits = joined(seeds, lists.select("h", "n", "text", "list"), ["h", "n", "text"])
    per_row = hits.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("hits"), F.array_sort(F.collect_set("list")).alias("lists"))
    per_row = written(per_row.select("row", F.pandas_udf(merged, "array<struct<start: int, length: int>>")("hits").alias("spans"), "lists", F.md5(F.array_join(F.col("lists").cast("array<string>"), ",")).alias("set")), "hits")
    sets = per_row.select("set", "lists").dropDuplicates(["set"]).select("set", F.explode("lists").alias("list"))
    named = sets.join(lists.select("list", "items").dropDuplicates(["list"]), "list").select("set", F.explode("items").alias("item"))
    items_of = written(named.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-sets")
    told = joined(per_row.select("row", "spans", "set"), items_of, ["set"]).drop("set")
    no_spans, no_items = F.array().cast("array<struct<start: int, length: int>>"), F.array().cast("array<string>")
    return read.select("row", "doc_id", "n_words").join(told.hint("shuffle_hash"), "row", "left").select("doc_id", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))
