"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from papertrail.plans import registry

_MODULES = [
    "papertrail.plans.q_retrieval",
    "papertrail.plans.q_text",
    "papertrail.plans.q_corpus",
    "papertrail.plans.q_metrics",
    "papertrail.plans.q_json",
    "papertrail.plans.q_search",
    "papertrail.plans.q_bib",
    "papertrail.plans.q_ml",
    "papertrail.plans.q_extract",
    "papertrail.plans.q_io",
    "papertrail.plans.q_refresh",
    "papertrail.plans.q_rouge",
]


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.SQL)
