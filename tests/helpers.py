from __future__ import annotations

import math


def norm(v):
    """A value as both engines write it."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return v


def rows(values) -> list[str]:
    return sorted(repr([norm(x) for x in r]) for r in values)


def same_as_sql(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    want = rows(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert got == want
