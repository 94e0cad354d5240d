"""Importing this module registers every query."""

from winnow.plans import basics, decisions, estimation, measures, records, series  # noqa: F401
from winnow.plans.registry import ORACLES, QUERIES  # noqa: F401
