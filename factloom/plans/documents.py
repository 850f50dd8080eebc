"""Queries of documents: sections, chunks, links, quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import combine, retrieval
from factloom.plans.catalog import query
from factloom.session import table as t
from factloom.sources import html


@query("DOC-03", oracle=r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="')) AS links, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS distinct_links, contains(html, '<h1>') AS has_h1 FROM pages""")
def html_title_links(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("html")
    hrefs = F.regexp_extract_all(body, F.lit('<a href="([^"]*)"'), 1)
    return t(spark, d, "pages").select("page_id", F.regexp_extract(body, "<title>([^<]*)</title>", 1).alias("title"), F.size(hrefs).cast("long").alias("links"), F.size(F.array_distinct(hrefs)).cast("long").alias("distinct_links"), F.contains(body, F.lit("<h1>")).alias("has_h1"))


@query("DOC-01", "DOC-02", "DOC-03", "DOC-07", "DUP-07", "STR-06", "CLS-08", "JSN-01", "JSN-02", "JSN-03", "JSN-04", "PAR-01")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return html.sections(t(spark, d, "pages").select("page_id", "html"), "page_id", "html")


@query("DOC-06", oracle="""
    SELECT doc_id, len(text) AS chars, (len(text) > 6000) AS cut, 0::BIGINT AS off FROM documents""")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """Chunks put together again with the line ends between them have the document's length."""
    c = chunked(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    ends = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("char_end").alias("last"), F.min("char_start").alias("first"), F.sum(F.col("char_end") - F.col("char_start") - F.char_length("text")).alias("off"))
    return t(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("chars")).join(ends, "doc_id").select("doc_id", "chars", (F.col("n") > 1).alias("cut"), "off")


def chunked(docs: DataFrame, key: str, text: str, most: int = html.MAX_SECTION) -> DataFrame:
    """One row a chunk with its place in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p, s, e) for k, x in zip(b[key], b[text], strict=True) for i, (p, s, e) in enumerate(html.chunks(x or "", most))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text", "char_start", "char_end"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, text string, char_start int, char_end int")


@query("RAG-02", "RAG-06", oracle="""
    WITH c AS (SELECT doc_id AS section_id, field, quote, raw_value FROM documents, (SELECT 'skills' AS field, text AS quote, substr(text, 1, 10) AS raw_value FROM benchmark))
    SELECT section_id, quote, raw_value FROM c JOIN documents d ON d.doc_id = section_id WHERE field = 'skills' AND contains(d.text, quote)""")
def quote_validation(spark: SparkSession, d: str) -> DataFrame:
    """Which documents quote which benchmark items word for word."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("section_id"), "text")
    items = t(spark, d, "benchmark").select(F.lit("skills").alias("field"), F.col("text").alias("quote"), F.substring("text", 1, 10).alias("raw_value"))
    near = combine.contained(docs, items, "section_id", "text", "quote").join(items, "quote")
    return retrieval.valid_quotes(near, docs, ["skills"]).select("section_id", "quote", "raw_value")
