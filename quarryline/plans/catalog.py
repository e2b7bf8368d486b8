"""All queries of the core with their SQL."""

from __future__ import annotations

from quarryline.plans import activity, code, data_quality, extraction

FLAGSHIP = "top_o01_hubs"
_PARTS = [code, extraction, activity, data_quality]


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in getattr(p, "SQL", {}).items()}
