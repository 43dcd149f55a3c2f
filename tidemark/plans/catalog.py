"""All panel queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import aggregates, clean, cross, evaluation, events, joins, micro, models, more, panels, paths, portfolio, recursions, regimes, sentiment, shapes, signals, states, strategies, technical  # noqa: F401  each module registers its queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
