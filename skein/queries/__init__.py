"""Registered queries of the core library over the test tables, with their SQL."""

from skein.plans.registry import QUERIES, SQL
from skein.queries import aggregates, extensions, graphs, joins, media, ranking, reasoning, scalars, search, storage, streams, supplements, vectors, windows

__all__ = ["QUERIES", "SQL", "aggregates", "extensions", "graphs", "joins", "media", "ranking", "reasoning", "scalars", "search", "storage", "streams", "supplements", "vectors", "windows"]
