"""Where cases on fixed rows and their results, as SQL, are registered by name."""

from __future__ import annotations

CASES, RESULTS = {}, {}


def query(sql: str):
    def register(f):
        CASES[f.__name__], RESULTS[f.__name__] = f, sql
        return f

    return register


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for fixed rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") v({', '.join(columns.split())})"
