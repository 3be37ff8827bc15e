"""Collects the registered queries from every catalog module."""

from __future__ import annotations


def _load():
    from . import catalog, catalog_ml, catalog_stream  # noqa: F401  (they register on import)

    return catalog.REGISTRY


def all_queries():
    return {k: fn for k, (fn, _) in _load().items()}


def all_oracles():
    return {k: sql for k, (_, sql) in _load().items() if sql is not None}
