"""Product quantisation of vectors: Lloyd's rounds by Elkan's bounds, on whole numbers.

A vector's components become integers and are cut into equal parts, each with a
codebook of its own. Between rounds every vector keeps, for each part, its
entry, an upper bound of the distance to it and a lower bound of the distance to
every entry. A round first shifts the bounds by how far entries have moved. A
part whose upper bound is below half the distance from its entry to any other
stays; else an entry is looked at only if neither its lower bound nor half its
distance from the present entry is above the upper bound. Both tests are strict,
so an entry at an equal distance is always looked at. What is looked at is
measured in 64-bit integers, and ties go to the lower index.

Bounds are single precision, rounded outwards, so that they never prune wrongly.
The state is a table in the shared folder, written once a round together with
each task's sums by part and entry; a round's table goes once the next is there.
Only codebooks reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import give_back, joined, received, send, written

#: Components beyond this magnitude could overflow 64-bit distances of vectors of up to MOST_DIMENSIONS.
LARGEST, MOST_DIMENSIONS = 1 << 24, 4096
#: Vectors that a task works on at a time.
ROWS = 1024


def whole_components(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as array<int>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def kept_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """id, label, q array<int> of the vectors that are present, not empty and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    q = whole_components(F.col("embedding"), scale)
    bounded = F.when(F.forall(q, lambda x: F.abs(x) <= LARGEST), q.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<int>"))
    return vectors.where(finite & (F.size("embedding") > 0)).select(F.col("vec_id").alias("id"), F.col("label").alias("label"), bounded.alias("q"))


def outward(x: np.ndarray, up: bool) -> np.ndarray:
    """In single precision, a step beyond the nearest value."""
    near = x.astype(np.float32)
    return np.nextafter(near, np.float32(np.inf)) if up else np.maximum(np.nextafter(near, np.float32(-np.inf)), np.float32(0))


def squares(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances in 64-bit integers, row by row of two aligned arrays."""
    d = q - book
    return np.einsum("...i,...i->...", d, d)


class Books:
    """The codebooks of a round as [part, entry, position], and what the round needs to know of them."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None):
        self.books = books
        apart = np.sqrt(squares(books[:, :, None], books[:, None, :]).astype(np.float64)) * (1 - 1e-12)
        self.half = apart / 2
        other = apart + np.where(np.eye(books.shape[1], dtype=bool), np.inf, 0)
        self.lonely = other.min(axis=2) / 2
        self.moved = None if before is None else np.sqrt(squares(books, before).astype(np.float64)) * (1 + 1e-12)

    def assign(self, p: int, q: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry, upper bound and lower bounds of rows of part p, from those of the round before; last, how many distances were measured."""
        book, n = self.books[p], len(q)
        if code is None:
            d = np.stack([squares(q, entry) for entry in book], axis=1)
            code = d.argmin(axis=1)
            root = np.sqrt(d.astype(np.float64))
            return code, outward(root[np.arange(n), code], True), outward(root, False), d.size
        upper = outward(upper.astype(np.float64) + self.moved[p][code], True)
        lower = outward(lower.astype(np.float64) - self.moved[p], False)
        code = code.copy()
        at = np.flatnonzero(~(upper < self.lonely[p][code]))
        own = squares(q[at], book[code[at]])
        root = np.sqrt(own.astype(np.float64))
        upper[at], lower[at, code[at]] = outward(root, True), outward(root, False)
        near = ~(upper[at, None] < lower[at]) & ~(upper[at, None] < self.half[p][code[at]])
        near[np.arange(len(at)), code[at]] = False
        i, c = np.nonzero(near)
        d = squares(q[at[i]], book[c])
        lower[at[i], c] = outward(np.sqrt(d.astype(np.float64)), False)
        table = np.full(near.shape, np.iinfo(np.int64).max)
        table[i, c], table[np.arange(len(at)), code[at]] = d, own
        code[at] = table.argmin(axis=1)
        upper[at] = outward(np.sqrt(table.min(axis=1).astype(np.float64)), True)
        return code, upper, lower, len(at) + len(d)


def _floats(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))


def _stepped(state: DataFrame, books: Books) -> DataFrame:
    """The state after one assignment, and after a task's last vector its sums: rows of part, entry, n and total."""
    fields = state.schema
    names = ["id", "label", "q", "code", "upper", "lower"]
    sent = send(state.sparkSession, books)
    first = "code" not in state.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(sent)
        parts, entries, d = books.books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        kinds = None
        for batch in (x.slice(a, ROWS) for x in batches for a in range(0, x.num_rows, ROWS)):
            rows = batch.num_rows
            lengths = np.diff(batch.column("q").offsets.to_numpy())
            if (lengths != parts * d).any():
                raise ValueError(f"vectors differ in length: {sorted({parts * d, *lengths.tolist()})}")
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, parts, d)
            code, upper, lower = np.empty((rows, parts), np.uint8), np.empty((rows, parts), np.float32), np.empty((rows, parts, entries), np.float32)
            if not first:
                old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(rows, parts).astype(np.int64)
                u = batch.column("upper").flatten().to_numpy(zero_copy_only=False).reshape(rows, parts)
                low = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(rows, parts, entries)
            for p in range(parts):
                code[:, p], upper[:, p], lower[:, p], _ = books.assign(p, q[:, p], *((None, None, None) if first else (old[:, p], u[:, p], low[:, p])))
                hit = code[:, p] == np.arange(entries)[:, None]
                n[p] += hit.sum(axis=1)
                total[p] += hit.astype(np.int64) @ q[:, p]
            kinds = kinds or (batch.column("id").type, batch.column("label").type)
            none = [pa.nulls(rows, x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("q"), pa.array([r.tobytes() for r in code], pa.binary()), _floats(upper), _floats(lower.reshape(rows, -1)), *none], [*names, "part", "entry", "n", "total"])
        if kinds:
            p, c = np.nonzero(n)
            none = [pa.nulls(len(p), x) for x in (*kinds, pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n[p, c], pa.int64()), pa.array(list(total[p, c]), pa.list_(pa.int64()))], [*names, "part", "entry", "n", "total"])
        give_back()

    kind = lambda c: fields[c].dataType.simpleString()
    return state.mapInArrow(run, f"id {kind('id')}, label {kind('label')}, q array<int>, code binary, upper array<float>, lower array<float>, part int, entry int, n long, total array<long>")


def _delete(table: DataFrame) -> None:
    """Removes a table of the shared folder that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rsplit("/", 1)[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's new place: floor(sum / count) of its parts; where it has none, its old one."""
    place = F.posexplode("total").alias("at", "x")
    found = state.where("part is not null").select("part", "entry", "n", place).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    new = books.copy()
    for r in found:
        new[r.part, r.entry, r.at] = r.x // r.n
    return new


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code binary (a byte a part) and error long of each vector kept, and the codebooks as [part, entry, position].

    vectors has vec_id, embedding and label; other columns end here, whatever their names. Vectors that are null, empty or
    hold a null or a non-finite component take no part. The others must have one length that parts divide, and
    components of magnitude up to 2^24 once scaled; else the job fails and says so. The codebooks start at the vectors of the
    smallest vec_ids (a null after all others, ties by the vector); of fewer vectors than entries, there are as many entries
    as vectors. Repeated rows are separate rows with equal results. Equal entries, as repeated vectors make them, tie: the lower index gets all. An empty table gives an empty table
    and no codebooks.
    """
    kept = kept_vectors(vectors, scale)
    start = kept.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not start:
        return kept.select(F.col("id").alias("vec_id"), "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    length = {len(r.q) for r in start}
    if len(length) > 1 or length.copy().pop() % parts or length.copy().pop() > MOST_DIMENSIONS:
        raise ValueError(f"vectors of lengths {sorted(length)} do not have {parts} equal parts")
    books = np.array([r.q for r in start], np.int64).reshape(len(start), parts, -1).swapaxes(0, 1)
    state, before = kept, None
    for _ in range(rounds):
        new = written(_stepped(state, Books(books, before)), "quantiser")
        if before is not None:
            _delete(state)
        before, books = books, _moved(new, books)
        state = new.where("part is null").select("id", "label", "q", "code", "upper", "lower")
    last = written(_stepped(state, Books(books, before)).where("part is null").select("id", "label", "q", "code"), "codes")
    return last.mapInArrow(_measure(last, books), StructType([StructField("vec_id", last.schema["id"].dataType), last.schema["label"], *[f for f in last.schema if f.name == "code"], StructField("error", LongType())])), books


def _measure(coded: DataFrame, books: np.ndarray):
    sent = send(coded.sparkSession, books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = received(sent)
        parts, _, d = books.shape
        for batch in (x.slice(a, ROWS) for x in batches for a in range(0, x.num_rows, ROWS)):
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, d)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            error = squares(q, books[np.arange(parts), code]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("code"), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over rows of an equal label, null labels together; hot labels are told apart."""
    keyed = written(coded.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("n"))), "coded")
    return joined(keyed, keyed.groupBy("_key").agg(F.sum("error").alias("label_error")), ["_key"]).drop("_key")


def decompress(codes: list[bytes], books: np.ndarray, scale: float = 4096.0) -> np.ndarray:
    """Vectors at the entries of their codes, in the middle of the whole components' cells."""
    code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, books.shape[0])
    return (books[np.arange(books.shape[0]), code].reshape(len(code), -1) + 0.5) / scale
