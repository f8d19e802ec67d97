"""Queries of the library by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import catalog_queries, page_queries, passage_queries, reader_queries, shard_queries, state_queries, surface_queries, text_queries

QUERIES = text_queries.QUERIES | catalog_queries.QUERIES | reader_queries.QUERIES | passage_queries.QUERIES | state_queries.QUERIES | shard_queries.QUERIES | surface_queries.QUERIES | page_queries.QUERIES
ORACLES = text_queries.ORACLES | catalog_queries.ORACLES | reader_queries.ORACLES | passage_queries.ORACLES | state_queries.ORACLES | shard_queries.ORACLES | surface_queries.ORACLES | page_queries.ORACLES
