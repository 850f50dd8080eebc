"""Joins and aggregations that recur: flags, shares, duplicates, nesting, containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ranking import global_rank, kept, top_one


def with_top_one(left: DataFrame, right: DataFrame, keys: Sequence[str], *order: Column | str, how: str = "inner") -> DataFrame:
    """left with the first matching row of right: a lateral join with a limit of one."""
    return left.join(top_one(right, keys, *order), list(keys), how)


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys (none null) of more rows than a partition's share, counted before the shuffle; they are fewer than there are partitions."""
    share = rows.count() / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(*keys))


def looked_up(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of known, which has each key once; null where it has none. rows are kept, as they are read twice.

    Rows of hot keys meet what is known of them by a broadcast, rows of null keys meet nothing, and only the rest is shuffled.
    """
    rows = kept(rows)
    hot = kept(hot_keys(rows, keys).join(known, list(keys), "left"))
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), list(keys), "left")
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    new = [c for c in known.columns if c not in keys]
    few = marked.where("_hot").drop("_hot").join(F.broadcast(hot), list(keys), "left")
    rest = marked.where(F.col("_hot").isNull() & ~null).drop("_hot").join(known, list(keys), "left")
    bare = marked.where(null).drop("_hot").withColumns({c: F.lit(None).cast(known.schema[c].dataType) for c in new})
    return few.unionByName(rest).unionByName(bare).select(*rows.columns, *new)


def exists_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """left with whether right has its key; rows are not multiplied."""
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def counts_with_zero(left: DataFrame, right: DataFrame, key: str, distinct: str, name: str) -> DataFrame:
    """left's keys with the number of distinct values on the right, 0 without any; right is counted before the join."""
    counted = right.groupBy(key).agg(F.count_distinct(distinct).alias(name))
    return left.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def share_of_total(df: DataFrame, key: str, digits: int = 4, keep: Column | None = None) -> DataFrame:
    """Count of each key and its share of all, null if there are none."""
    counted = df.where(keep if keep is not None else F.lit(True)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.nullif("total", F.lit(0)), digits)).drop("total")


def duplicate_groups(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Keys (none null) that several rows hold, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").dropna()


def facts_by_field(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row for each field of each row: field, state."""
    return df.unpivot([key], list(fields), "field", "state")


def grouped_map(df: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """key to a map of field to its sorted values."""
    inner = df.groupBy(key, field).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    return inner.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "_v")))).alias("by_field"))


def any_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: Sequence[tuple[str, str]]) -> DataFrame:
    """left_key, right_key, matched_by (from 1): pairs that agree on one of several keys, by the first that agrees.

    A union of equi-joins, as an OR of keys would compare all pairs.
    """
    parts = [left.select(left_key, F.col(a).alias("_k")).where("_k is not null").join(right.select(right_key, F.col(b).alias("_k")), "_k").select(left_key, right_key, F.lit(i + 1).alias("matched_by")) for i, (a, b) in enumerate(on)]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return union.groupBy(left_key, right_key).agg(F.min("matched_by").alias("matched_by"))


def contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 4, few: int = 1000) -> DataFrame:
    """key, name: the names (of `least` characters or more) that each text contains.

    A list of at most `few` names goes to every task. A longer one is looked up by the names' first characters at every
    place of the text, so that the join is an equi-join.
    """
    usable = names.select(F.col(name)).where(F.char_length(name) >= least).distinct()
    if usable.limit(few + 1).count() <= few:
        return texts.select(key, text).join(F.broadcast(usable), F.contains(F.col(text), F.col(name))).select(key, name)
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - least + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(least))))
    near = texts.select(key, F.explode(places).alias("_gram")).join(usable.withColumn("_gram", F.substring(name, 1, least)), "_gram").select(key, name)
    return near.join(texts.select(key, text), key).where(F.contains(F.col(text), F.col(name))).select(key, name)


def longest_contained(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 4, few: int = 1000) -> DataFrame:
    """Each text's longest name that it contains (ties: the first by code point); names shorter than `least` don't count."""
    found = contained(texts, names, key, text, name, least, few)
    return found.groupBy(key).agg(F.min_by(name, F.struct(-F.char_length(name), name)).alias(name))


def fingerprint(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """SHA-256 over each key's sorted values, one a line."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("fingerprint"))


def histogram(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Counts, largest first, then by name."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def ranked_histogram(df: DataFrame, key: Column, name: str = "key", collation: str = "ja") -> DataFrame:
    """Counts with their places (rank, from 1): the largest first, equal ones by a language's order of names, then by code points; a null is last among equals."""
    counts = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counts, F.desc("n"), F.asc_nulls_last(F.collate(F.col(name), collation)), F.col(name))


def facet_counts(df: DataFrame, key: str, families: Column, all_families: DataFrame, name: str = "family") -> DataFrame:
    """How many rows each family has, a row once for each of its families; families without rows have 0."""
    each = df.select(key, F.explode(F.array_distinct(families)).alias(name)).groupBy(name).agg(F.count_distinct(key).alias("n"))
    return all_families.join(each, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def precision_recall(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    tp, fp, fn = F.count_if(truth & said), F.count_if(~truth & said), F.count_if(truth & ~said)
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(tp / F.nullif(tp + fp, F.lit(0)), 6).alias("precision"), F.round(tp / F.nullif(tp + fn, F.lit(0)), 6).alias("recall"))
