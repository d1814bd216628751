"""Composed queries and experiments."""

from . import decisions, experiments, plots, reading, runners, scores, sensor, serving, small  # noqa: F401  registers its queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
