"""All registered queries."""

from __future__ import annotations

from tidemark.plans import cleaning, modelling, people, routes, scoring, search, series, tabular, texts  # noqa: F401
from tidemark.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
