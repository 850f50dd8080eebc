"""Exact top-k by inner product with vector-approximation files.

Vectors are dealt to blocks of bounded size; each block is quantised once to a
few cells in each dimension and stored. Then all queries stream past each block,
batch by batch. Middles and half widths of the cells give an upper and a lower
bound of every vector's score in two products in single precision, with room for
its rounding; the k-th best lower bound drops what cannot be a result, and the
rest is read exactly in the order of its upper bounds until the next bound is
below the k-th exact score. Components are whole numbers, so all sums are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks_for, finite, give_back, written

CELLS = 16
#: Vectors of a block; queries bounded at once and vectors read at once inside a task.
VECTORS, ABREAST, READ = 32_768, 128, 128
LEAST_BLOCKS = 12


def unique_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows whose components are all finite; equal vec_ids are one row, a null vec_id is none."""
    return table.where(F.col("vec_id").isNotNull() & finite(F.col(vector))).groupBy("vec_id").agg(F.min(vector).alias("vector"))


def indexed(vectors: DataFrame, per_block: int, build: Callable[[np.ndarray, np.ndarray], bytes], least: int = LEAST_BLOCKS) -> tuple[DataFrame, int]:
    """Stored indexes d, index of the blocks of vectors (vec_id, vector), each built once, and the number of blocks."""
    blocks = blocks_for(vectors.count(), per_block, least)

    def run(table: pa.Table) -> pa.Table:
        made = build(table.column("vec_id").to_numpy(), matrix(table.column("vector")))
        give_back()
        return pa.table({"d": table.column("d")[:1], "index": pa.array([made], pa.binary())})

    dealt = vectors.withColumn("d", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("d").applyInArrow(run, "d int, index binary"), "index"), blocks


def streamed(indexes: DataFrame, blocks: int, queries: DataFrame, search: Callable[[bytes], Callable], score: str) -> DataFrame:
    """query_id, vec_id and score found for each query in each block.

    A task holds one block's index, which comes first in the order of its rows, and one batch of the queries after it.
    search takes an index and returns a function of query ids and vectors that yields id, ids found and scores.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("d")
    none = F.lit(None)
    asked = queries.select(every, F.lit(1).alias("kind"), "vec_id", F.col("vector").cast("array<double>").alias("vector"), none.cast("binary").alias("index"))
    rows = indexes.select("d", F.lit(0).alias("kind"), none.cast("long").alias("vec_id"), none.cast("array<double>").alias("vector"), "index").union(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, find = None, None
        for batch in batches:
            d, kind = batch.column("d").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(cuts, cuts[1:], strict=False):
                if kind[a] == 0:
                    block, find = d[a], search(batch.column("index")[int(a)].as_py())
                elif block == d[a]:  # a block without vectors has no index
                    part = batch.slice(a, b - a)
                    found = list(find(part.column("vec_id").to_numpy(), matrix(pa.chunked_array([part.column("vector")]))))
                    sizes = [len(ids) for _, ids, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], sizes).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in found]).astype(np.int64)), pa.array(np.concatenate([s for _, _, s in found]))], names=["query_id", "vec_id", "score"])
        del find
        give_back()

    return rows.repartition("d").sortWithinPartitions("d", "kind").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of an array column, with zeros where a row is shorter than the longest."""
    flat = column.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def as_wide(y: np.ndarray, width: int) -> np.ndarray:
    """Rows of so many components: zeros added, or those left out that meet zeros of shorter vectors."""
    return y[:, :width] if y.shape[1] >= width else np.pad(y, ((0, 0), (0, width - y.shape[1])))


class Cells:
    """A block: ids in order, exact vectors x, the cell of each component (code), and the lowest and highest value in each cell."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.ids, self.x, self.code = ids, x, code
        self.middle, self.half = (least + most) / 2, (most - least) / 2
        self.largest = float(np.abs(x).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, cells: int = CELLS) -> Cells:
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        low, high = x.min(0), x.max(0)
        code = np.minimum(((x - low) * (cells / np.maximum(high - low, 1))).astype(np.int64), cells - 1).astype(np.uint8)
        least, most = np.zeros((cells, x.shape[1])), np.zeros((cells, x.shape[1]))
        for c in range(cells):
            inside = code == c
            some = inside.any(0)
            least[c, some] = np.where(inside, x, np.inf).min(0)[some]
            most[c, some] = np.where(inside, x, -np.inf).max(0)[some]
        return cls(ids, x, code, least, most)

    def packed(self) -> bytes:
        small = self.x.astype(np.int32) if self.largest < 2**31 else self.x
        return pickle.dumps((self.ids, small, self.code, self.middle - self.half, self.middle + self.half))

    @classmethod
    def unpacked(cls, raw: bytes) -> Cells:
        ids, x, *cells = pickle.loads(raw)
        return cls(ids, x.astype(np.float64), *cells)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of queries (rows) by vectors (columns)."""
        q, size, dims = queries.astype(np.float32), np.abs(queries).astype(np.float32), np.arange(self.code.shape[1])
        middle, half = self.middle.astype(np.float32), self.half.astype(np.float32)
        scores, widths = np.empty((len(q), len(self.code)), np.float32), np.empty((len(q), len(self.code)), np.float32)
        for at in range(0, len(self.code), 8192):
            code = self.code[at : at + 8192]
            scores[:, at : at + 8192] = q @ middle[code, dims].T
            widths[:, at : at + 8192] = size @ half[code, dims].T
        # single precision rounds each product and sum by 2^-24 of what is added up
        rounding = (4 + len(dims)) * 2.0**-23 * self.largest * size.sum(1, keepdims=True)
        widths += rounding.astype(np.float32) + np.float32(1e-30)
        return scores - widths, scores + widths

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """query id, ids and scores of its k best vectors (not its own), best first, ties to smaller ids."""
        queries = as_wide(queries, self.x.shape[1])
        fits = self.largest * float(np.abs(queries).max(initial=0)) * self.x.shape[1] < 2**53
        x, asked = (self.x, queries) if fits else (self.x.astype(np.int64), queries.astype(np.int64))
        for at in range(0, len(queries), ABREAST):
            lows, highs = self.bounds(queries[at : at + ABREAST])
            for row, (low, high) in enumerate(zip(lows, highs, strict=True)):
                own = query_ids[at + row]
                low[self.ids == own] = high[self.ids == own] = -np.inf
                limit = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                some = np.flatnonzero((high >= limit) & np.isfinite(high))
                some = some[np.argsort(-high[some], kind="stable")]
                best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for start in range(0, len(some), READ):
                    if len(score) == k and score[-1] > high[some[start]]:
                        break
                    read = some[start : start + READ]
                    best, score = np.concatenate([best, read]), np.concatenate([score, (x[read] @ asked[at + row]).astype(np.int64)])
                    first = np.lexsort((best, -score))[:k]
                    best, score = best[first], score[first]
                yield int(own), self.ids[best], score


def exact_top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, per_block: int = VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score long: the k best vectors of table for each row of queries (vec_id, embedding each).

    Components x become floor(scale * x); the score is their inner product, a whole number. Ties go to the
    smaller vec_id; a query's own vec_id is no candidate. Null and empty vectors and those with null or
    non-finite components take no part, nor do rows without vec_id; equal vec_ids are one row. Of vectors of
    different lengths, the shorter counts as filled up with zeros. Sums beyond 64 bits are not defined.
    Other columns are not read; empty tables give an empty result.
    """
    indexes, blocks = indexed(unique_vectors(table), per_block, lambda ids, x: Cells.of(ids, whole(x, scale)).packed())

    def search(raw: bytes) -> Callable:
        cells = Cells.unpacked(raw)
        return lambda ids, y: cells.search(ids, whole(y, scale), k)

    return best(streamed(indexes, blocks, unique_vectors(queries), search, "long"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of all blocks for each query, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
