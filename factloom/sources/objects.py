"""Immutable raw bytes by their hash, and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.tables import BucketTable, append_once


def key_of(hash_: str) -> str:
    """The key of an object; anything but a SHA-256 in hexadecimal is refused, so no key leaves its folder."""
    if not re.fullmatch("[0-9a-f]{64}", hash_):
        raise ValueError("not a SHA-256")
    return f"raw/sha256/{hash_[:2]}/{hash_}"


class RawObjects:
    """Objects as a table dealt to buckets by hash: put_if_absent adds what is not there, delete may be repeated. Either writes in the buckets that it meets alone."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.store = spark, BucketTable(spark, root, ["hash"], buckets)

    def table(self) -> DataFrame:
        rows = self.store.rows()
        return self.spark.createDataFrame([], "hash string, key string, bytes binary") if rows is None else rows

    def put_if_absent(self, objects: DataFrame, column: str = "bytes") -> int:
        """Adds the bytes that are new; returns how many."""
        hash_ = F.sha2(column, 256)
        rows = objects.select(hash_.alias("hash"), F.concat(F.lit("raw/sha256/"), F.substring(hash_, 1, 2), F.lit("/"), hash_).alias("key"), F.col(column).alias("bytes"))
        return append_once(self.store, rows, "hash")

    def get(self, hash_: str) -> bytes | None:
        found = self.store.lookup(self.spark.createDataFrame([(hash_,)], "hash string"))
        row = found.select("bytes").first() if found is not None else None
        return bytes(row[0]) if row else None

    def delete(self, hashes: DataFrame) -> None:
        if self.store.rows() is not None:
            self.store.change(hashes.select("hash").distinct(), lambda old, gone: old.join(gone, "hash", "left_anti"))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
