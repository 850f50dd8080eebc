"""Shared helpers: scratch tables in the cluster's shared folder, words, hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import pickle
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (space and U+0009 to U+000D) and the letters that lower-casing touches.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, dealt: int = 0) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key, so that groups and joins by it need no shuffle; dealt: first brought together so."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(dealt, key) if dealt else df
    rows.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.read.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


#: What bytes.translate needs to lower-case A-Z and turn every other ASCII character that is no digit or letter into a space.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a lower-cased text in UTF-8; a null has none."""
    return text.translate(PLAIN).split() if text else []


def byte_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Start, end and texts in UTF-8 of consecutive slices of about `most` bytes; a longer text is a slice of its own."""
    whole = texts.cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False))
    at, n = 0, len(whole)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to, whole.slice(at, to - at).to_pylist()
        at = to


def joined(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of known, which has each key once; rows must be a written table, as they are read twice.

    Keys of more rows than a partition's share are told apart by a count that is summed before its shuffle; they
    are fewer than there are partitions, and their rows of known are broadcast. All other keys are shuffled.
    """
    share = max(1000, math.ceil(rows.count() / shuffle_partitions(rows.sparkSession)))
    hot = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(*keys, F.lit(True).alias("_hot")))
    marked = rows.join(F.broadcast(hot), keys, "left")
    few = checkpointed(known.join(F.broadcast(hot.drop("_hot")), keys, "left_semi"))
    apart = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys)
    return apart.unionByName(marked.where("_hot is null").drop("_hot").join(known.hint("shuffle_hash"), keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(rows: int, per_block: int, least: int) -> int:
    """Number of equal blocks for a table; grows with the rows, so that a block's size stays bounded."""
    return max(least, math.ceil(rows / per_block))


def finite(c: Column) -> Column:
    """Whether an array column is present, not empty, and holds finite numbers only."""
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(ok & (F.size(c) > 0), F.lit(False))


def field(name: str, of: str = "") -> Column:
    """The column of that very name, dots and all, or the field of that name of a struct column."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def packed(df: DataFrame, *new: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns of df, or these, in one struct `_user` beside the new ones, so that no helper column can meet a user's of its name."""
    whole = F.struct(*[field(c) for c in (df.columns if columns is None else columns)])
    return df.select(whole.alias("_user"), *new)


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the user's rows as they were, with the new ones in place of those of their names or after them."""
    both = df.select("_user", F.struct(*[v.alias(c) for c, v in new.items()]).alias("_new"))
    return both.select(*[field(c, "_new" if c in new else "_user").alias(c) for c in [*columns, *(c for c in new if c not in columns)]])


def send(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of a value with its class, so that executors need not have this package; `received` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> Any:
    return pickle.loads(sent.value)


def give_back() -> None:
    """Returns a task's free memory to the system, as Python workers live on and the next task may be another operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
