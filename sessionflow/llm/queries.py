"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat, decontaminate, fixity, lines, mixing, quality, repair, repeats, secrets, shards, simhash, whitening

_MODULES = (lines, mixing, simhash, decontaminate, secrets, chat, ann, fixity, quality, repeats, whitening, shards, repair)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
