"""All registered queries of the library and their SQL."""

from __future__ import annotations

from grafita.plans import q_evidence, q_extract, q_files, q_history, q_match, q_more, q_scores

_MODULES = (q_match, q_more, q_extract, q_evidence, q_scores, q_files, q_history)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLE.items()}
