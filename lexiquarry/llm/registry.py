"""Queries and SQL of this subpackage's operators, by query name."""

from __future__ import annotations

from . import hard_negatives, hnsw, jaccard_join, kneser_ney, lattice_lm, license_scan, mixing, packing, quality_rules, toxicity, url_filters, warc, whitening

_MODULES = (packing, url_filters, warc, mixing, kneser_ney, hnsw, quality_rules, jaccard_join, lattice_lm, toxicity, whitening, hard_negatives, license_scan)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
