"""The registered queries of this package and their SQL, collected from its operators' query modules."""

from __future__ import annotations

from . import queries_corpus, queries_terms, queries_tokens

MODULES = (queries_corpus, queries_tokens, queries_terms)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
