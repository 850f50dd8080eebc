"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, source mixture, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and no others: extra columns end here, whatever their
names. Nulls are as in the operators: a null text is an empty one, a null doc_id
is one more id after all others, a null source is a source of its own. Texts are
taken whole. Every stage takes an empty table and returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, linededup, mixture, simhash, toxicity
from factloom.llm.common import written
from factloom.llm.queries import tokenizer_path
from factloom.session import table

#: Near duplicates are alike in five-word shingles: fingerprints of which one of two is within 8 of 64 bits, and both
#: together within 24 of 128, which is the expected distance at a similarity of about 0.75.
NEAR = {"size": 5, "budget": 8, "more": 1, "within": 24}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out fifth, does not call toxic. Repeated rows get equal scores."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; n_chars follows the text. Rows of one doc_id are one document and keep each other's lines."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, and of several with it the smallest text hash. Of equal rows one stays."""
    last = F.lit((1 << 63) - 1)
    first = F.struct(F.coalesce("doc_id", last).alias("_id"), F.col("row").alias("_row"))
    stay = simhash.near_duplicates(docs, **NEAR).groupBy("group").agg(F.min(first).alias("_first")).select("_first.*")
    rows = docs.withColumn("_doc", F.coalesce("doc_id", last)).withColumn("_text", F.xxhash64("text"))
    one = rows.join(stay.hint("shuffle_hash"), (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_row")))
    return one.dropDuplicates(["_doc", "_text"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them, sorted by training position.

    A document stands taken / size times, rounded: where the mix takes less than half of it, it does not stand at all.
    """
    return mixture.training_order(mixture.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids as the tokenizer encodes each whole text, and the SHA-256 of the decoded text."""
    return bpe.encode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_near_duplicates),
    ("source mixture", mix_sources),
    ("bpe encoding", encode),
]

#: A trained classifier and fingerprint components have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
