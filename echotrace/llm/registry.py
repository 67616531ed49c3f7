"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codefiles, components, mixing, neardup, packing, residue, spans

_MODULES = (components, spans, neardup, codefiles, packing, mixing, residue)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
