"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from strandline.llm import chat, decontaminate, jaccard, language, licenses, mixing, packing, quality, ranking, secrets, sharding, spelling, urls

MODULES = (sharding, decontaminate, chat, secrets, licenses, mixing, jaccard, language, urls, quality, spelling, packing, ranking)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
