"""Registered queries, grouped by family; importing a module registers its queries."""

from . import base, monthly, customer, pricing, product, scoring, insights, datasets, places, quality, actions, forecast, evaluate  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
