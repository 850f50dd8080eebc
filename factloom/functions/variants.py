"""Open JSON documents as VARIANT columns: record sets, search of a key at any depth, merging, lengths, presence.

A VARIANT keeps the keys of an object sorted, not in the order of the text; where order shows, it is that of paths.
All of it is column expressions: a document stays in its row, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType

#: Fixed value: how deep a key is looked for.
DEEPEST = 8
_FOUND = "array<struct<path: string, value: variant>>"


def fields(v: Column) -> Column:
    """The map of an object's keys and values; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """The array of an array's elements; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def records(df: DataFrame, document: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """df's other columns and a row for each record of the JSON array in a column, with the columns of schema by name.

    A key that a record lacks, and a JSON null, is null; a key that the schema lacks is left out; a VARIANT field takes any value.
    Numbers in strings are cast. A value that cannot be cast, a text that is no JSON and one that is no array of objects are errors
    if strict, else nulls and no rows. A null document and an empty array have no rows. Columns of df named like fields are replaced.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parse = F.parse_json if strict else F.try_parse_json
    get = F.variant_get if strict else F.try_variant_get
    others = [c for c in df.columns if c != document and c not in schema.names]
    one = lambda f: f'$["{f.name}"]'
    listed = elements(F.col("_v"))
    if strict:
        listed = F.when(F.col("_v").isNull() | listed.isNotNull(), listed).otherwise(F.raise_error(F.lit("a record set is an array")).cast("array<variant>"))
    each = df.select(*others, parse(F.col(document)).alias("_v")).select(*others, F.explode(listed).alias("_r"))
    whole = fields(F.col("_r")).isNotNull()
    each = each.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a record is an object")).cast("boolean"))) if strict else each.where(whole)
    typed = [get(F.col("_r"), one(f), f.dataType.simpleString()).alias(f.name) if not isinstance(f.dataType, VariantType) else F.try_variant_get(F.col("_r"), one(f), "variant").alias(f.name) for f in schema.fields]
    return each.select(*others, *typed)


def _node(path: Column, value: Column) -> Column:
    """A value with its path, as an object and as an array, each read once."""
    return F.struct(path.alias("path"), fields(value).alias("o"), elements(value).alias("a"))


def _children(node: Column) -> Column:
    """The objects and arrays in a node, with their paths: fields as .key, elements as [place], places of equal width so that paths sort by them."""
    in_object = F.transform(F.map_entries(node["o"]), lambda e: _node(F.concat(node["path"], F.lit("."), e["key"]), e["value"]))
    in_array = F.transform(node["a"], lambda v, i: _node(F.concat(node["path"], F.lit("["), F.lpad(i.cast("string"), 6, "0"), F.lit("]")), v))
    return F.filter(F.coalesce(in_object, in_array), lambda n: n["o"].isNotNull() | n["a"].isNotNull())


def find_key(df: DataFrame, document: str, key: str, to: str = "found", deepest: int = DEEPEST) -> DataFrame:
    """df with an array `to` of struct(path, value) of all values under a key, at any place down to `deepest` objects or arrays below the root.

    The column holds a VARIANT. Values come in the order of their paths; what stands inside a found value is looked through as well.
    A null document, and one that is no object or array, has an empty array. Each level is a projection of its own, so that no level is worked out twice.
    """
    names = [c for c in df.columns if c != to]
    root = F.filter(F.array(_node(F.lit("$"), F.col(document))), lambda n: n["o"].isNotNull() | n["a"].isNotNull())
    level = df.select(*names, root.alias("_level"), F.array().cast(_FOUND).alias("_found"))
    for depth in range(deepest + 1):
        under = F.filter("_level", lambda n: F.coalesce(F.map_contains_key(n["o"], key), F.lit(False)))
        hit = F.transform(under, lambda n: F.struct(F.concat(n["path"], F.lit("." + key)).alias("path"), n["o"][key].alias("value")))
        inner = F.flatten(F.transform("_level", _children)) if depth < deepest else F.col("_level")
        level = level.select(*names, inner.alias("_level"), F.concat("_found", hit).alias("_found"))
    ordered = F.array_sort("_found", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return level.select(*names, ordered.alias(to))


def has_key(v: Column, key: str) -> Column:
    """Whether an object has a key, an array has it as a string, or it is that string; false for anything else."""
    strings = F.try_variant_get(v, "$", "array<string>")
    typed = F.exists(elements(v), lambda e: F.schema_of_variant(e) == "STRING")
    same = (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == key)
    return F.coalesce(F.map_contains_key(fields(v), key), typed & F.array_contains(strings, key), same, F.lit(False))


def length(v: Column) -> Column:
    """The number of elements of an array; null for anything else."""
    return F.when(elements(v).isNotNull(), F.size(elements(v)))


def merge(a: Column, b: Column) -> Column:
    """Two objects as one, in which b's values win; anything else as one array of the elements of arrays and of single values. Null if either is."""
    mine, other = fields(a), fields(b)
    left = F.map_filter(mine, lambda k, _: ~F.map_contains_key(other, k))
    listed = lambda v: F.coalesce(elements(v), F.array(v))
    both = mine.isNotNull() & other.isNotNull()
    as_object, as_array = F.to_variant_object(F.map_concat(left, other)), F.to_variant_object(F.concat(listed(a), listed(b)))
    return F.when(a.isNull() | b.isNull(), None).when(both, as_object).otherwise(as_array)
