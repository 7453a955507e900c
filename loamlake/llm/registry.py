"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from loamlake.llm import chat_format, hash_forest, line_dedup, mixing, ngram_join, packing, quality, secrets_scan, token_counts, url_filters

_MODULES = (url_filters, ngram_join, line_dedup, mixing, secrets_scan, token_counts, hash_forest, quality, packing, chat_format)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
