"""Operators of a training-data pipeline, their queries and the SQL that states the same results."""

from __future__ import annotations

from . import bpe_tree, chat, collocations, exact_dedup, language, license_scan, manifest, packing, quality, sharding, simhash, substrings, token_store

MODULES = (chat, exact_dedup, bpe_tree, token_store, simhash, license_scan, quality, language, packing, substrings, collocations, manifest, sharding)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
