"""Registry of the queries over the driver's tables: what each covers, its function, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Operators of the survey's inventory that a query exercises.
COVERS: dict[str, tuple[str, ...]] = {}
FLAGSHIP = "latest_event_per_user"


def query(*covers: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], COVERS[f.__name__] = f, covers
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from factloom.plans import canonical, collect, documents, domain, expansion, extraction, lives, parsing, profiles, promotion, recall, relational, scalars, state, variants, workflow  # noqa: F401


load()
