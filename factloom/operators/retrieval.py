"""Ranking a document's sections for fields by kind and keywords, and checking quotes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ranking import top_one


def rank_sections(sections: DataFrame, doc: str, ordinal: str, text: str, fields: dict[str, tuple[Column, Sequence[str]]], per_field: int = 4, most: int = 8, similarity: str | None = None) -> DataFrame:
    """Sections chosen for a document: each field takes its best by 100 for the kind and 10 a keyword, if above 0;
    together in order, at most `most`. A document of which nothing is chosen so has its `most` sections of the largest
    similarity (a column, null: none), if that is given."""
    score = lambda kind, keywords: F.when(kind, 100).otherwise(0) + 10 * reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in keywords], F.lit(0))
    scored = sections.select(doc, ordinal, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), score(*f).alias("score")) for n, f in fields.items()])).alias("x")).select(doc, ordinal, "x.*").where("score > 0")
    chosen = top_one(scored, [doc, "field"], F.desc("score"), ordinal, k=per_field).select(doc, ordinal).distinct()
    kept = chosen.withColumn("_i", F.row_number().over(Window.partitionBy(doc).orderBy(ordinal))).where(F.col("_i") <= most).drop("_i")
    if similarity:
        rest = sections.where(F.col(similarity).isNotNull()).join(kept, doc, "left_anti")
        kept = kept.union(top_one(rest, [doc], F.desc(similarity), ordinal, k=most).select(doc, ordinal))
    return sections.join(kept, [doc, ordinal])


def cosines(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with the cosine of two vectors, in double precision, one product for each batch of rows.

    Null where a vector is null, of another length, zero, or holds a null or a number that is not finite.
    """
    own = [c for c in pairs.columns if c != name]

    def usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        right = lengths == size
        filled = pc.if_else(pa.array(right), column, pa.scalar([0.0] * size, column.type)) if not right.all() else column
        x = filled.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
        return x, right & np.isfinite(x).all(axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, np.nan)
            both = [batch.column(own.index(c)) for c in (a, b)]
            for size in pc.unique(pc.list_value_length(both[0]).drop_null()).to_pylist():
                (x, ok_x), (y, ok_y) = (usable(c, size) for c in both)
                with np.errstate(all="ignore"):
                    cosine = np.einsum("ij,ij->i", np.nan_to_num(x), np.nan_to_num(y)) / (np.linalg.norm(np.nan_to_num(x), axis=1) * np.linalg.norm(np.nan_to_num(y), axis=1))
                good = ok_x & ok_y & np.isfinite(cosine)
                score[good] = cosine[good]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64(), from_pandas=True)], [*own, name])

    kept_columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*own).schema)
    return pairs.select(*own).mapInArrow(run, f"{kept_columns}, `{name}` double")


def nearest_sections(sections: DataFrame, queries: DataFrame, doc: str, ordinal: str, vector: str, query: str, model: str, dimensions: int, k: int = 8) -> DataFrame:
    """doc, ordinal, similarity, place (from 1): each document's k sections nearest to its own query vector, ties to the smaller ordinal.

    sections: doc, ordinal, vector, model, dimensions. queries: doc and its vector, one a document. Only sections of that model and
    of so many dimensions take part. A document's sections are never brought together: their scores are, k a task.
    """
    own = sections.where((F.col("model") == model) & (F.col("dimensions") == dimensions)).select(doc, ordinal, F.col(vector).alias("_v"))
    scored = cosines(own.join(queries.select(doc, F.col(query).alias("_q")), doc), "_v", "_q", "similarity").where("similarity is not null").drop("_v", "_q")
    order = (F.desc(F.round("similarity", 9)), ordinal)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("place") <= k)


def valid_quotes(candidates: DataFrame, sections: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Candidates (section_id, field, quote, raw_value) whose field is asked for, whose quote stands word for word in a
    known section, and whose value and quote contain one another."""
    known = sections.select("section_id", F.col("text").alias("_text"))
    holds = F.contains("quote", "raw_value") | F.contains("raw_value", "quote")
    return candidates.where(F.col("field").isin(list(requested))).join(known, "section_id").where(F.contains("_text", "quote") & holds & (F.char_length("quote") > 0)).drop("_text")


def only_known(ids: Column, known: Column) -> Column:
    """Whether all ids are among the known ones."""
    return F.size(F.array_except(ids, known)) == 0
