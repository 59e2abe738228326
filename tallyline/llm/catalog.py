"""The queries of the text operators and their SQL."""

from __future__ import annotations

from tallyline.llm import decontamination, exact_dedup, language_id, licenses, mixing, pii, quality, secrets, sentencepieces, simhash, toxicity, vector_codes, whitening

_MODULES = [decontamination, exact_dedup, language_id, licenses, mixing, pii, quality, secrets, sentencepieces, simhash, toxicity, vector_codes, whitening]

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
