"""Ordered rule lists compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import js


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule (value, pattern) that the text matches."""
    return F.coalesce(*[F.when(text.rlike(js(p)), F.lit(v)) for v, p in rules], F.lit(otherwise))


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The values of all rules that the text matches, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(js(p)), F.lit(v)) for v, p in rules])))


def matched_numbers(text: Column, patterns: Sequence[str]) -> Column:
    """Numbers (from 0) of the patterns that the text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(js(p)), F.lit(i)) for i, p in enumerate(patterns)]))


def case(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit(otherwise))


def unless_empty(text: Column) -> Column:
    """The text, or null if it is empty, worked out once; nullif does it twice."""
    return once(text, lambda t: F.when(t != "", t))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f uses it, and outside of the generated method of its stage."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)
