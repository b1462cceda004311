"""The registered training-data queries and their DuckDB counterparts."""

from __future__ import annotations

from ledgerlake.llm import clustering, decontaminate, language_model, licenses, line_dedup, media, packing, quality, resampling, secrets, simhash, token_files, warc

_MODULES = (token_files, secrets, quality, warc, packing, media, simhash, licenses, line_dedup, decontaminate, clustering, resampling, language_model)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
