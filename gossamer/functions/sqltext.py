"""Python values as DuckDB writes them, for the queries' twins."""

from __future__ import annotations


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, dict):
        return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in x.items()) + "}"
    return repr(x)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
