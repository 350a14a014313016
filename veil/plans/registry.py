"""Registry of named queries: a Spark builder and (optionally) its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    # importing the modules registers their queries
    from veil.plans import (q_dialogue, q_redaction, q_classify, q_lmdata, q_fewshot,  # noqa: F401
                            q_attack, q_metrics, q_privacy, q_spectral, q_sources)
    return QUERIES, ORACLES
