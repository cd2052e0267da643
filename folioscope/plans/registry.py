"""All queries over the driver tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from . import curation, geometry, metadata, search, star, streams, tables, texts, vectors  # noqa: F401  each registers its queries
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "rank_topk"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
