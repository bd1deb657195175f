"""Queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

from nightledger.session import tune


def _load() -> None:
    from nightledger.plans import catalogue, measures, selection, summaries  # noqa: F401


def queries() -> dict:
    from nightledger.plans.registry import QUERIES

    _load()
    return {name: _tuned(fn) for name, fn in QUERIES.items()}


def _tuned(fn):
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)

    return run


def oracles() -> dict:
    from nightledger.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
