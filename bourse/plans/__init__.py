"""Registered queries, the tables they run on, and their SQL oracles."""

import importlib

_MODULES = ("price_queries", "statement_queries", "backtest_queries", "model_queries")


def load():
    """(queries by key, oracle SQL by key)"""
    from bourse.plans import registry
    for m in _MODULES:
        importlib.import_module(f"bourse.plans.{m}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
