"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quire.llm import bpe, decontaminate, langid, mtree, pii, quality, secrets, simhash, substrings, warc

_MODULES = (warc, mtree, substrings, decontaminate, bpe, simhash, langid, quality, secrets, pii)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
