"""All queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from epochal.plans import audits, evaluation, evidence, language, retrieval, temporal

_PARTS = (temporal, retrieval, evaluation, language, audits, evidence)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
