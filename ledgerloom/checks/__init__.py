"""Registered checks of the engine's operators."""

from ledgerloom.checks import catalog_queries, category_queries, ledger_queries, statement_queries  # noqa: F401
from ledgerloom.checks.registry import ORACLES, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict:
    return dict(ORACLES)
