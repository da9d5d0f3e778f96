"""The registered query catalog: Spark builders and DuckDB oracle SQL."""

from __future__ import annotations

from loupe.plans import model_queries, python_queries, report_queries, text_queries, vector_queries

_MODULES = [text_queries, vector_queries, model_queries, python_queries, report_queries]


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        dup = set(out) & set(m.QUERIES)
        if dup:
            raise ValueError(f"query names registered twice: {sorted(dup)}")
        out.update(m.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
