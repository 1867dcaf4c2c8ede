"""Imports every query module so that the registry is complete."""

from . import queries_grid, queries_register, queries_select, queries_views  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
