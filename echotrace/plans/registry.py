"""All core queries and the SQL they are checked against."""

from __future__ import annotations

from . import buckets, clones, deadcode, detect, files, text

_MODULES = (buckets, files, text, clones, detect, deadcode)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
