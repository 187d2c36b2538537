"""The library's queries over the test tables, with their SQL."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.tables import QUERIES

__all__ = ["ORACLES", "QUERIES"]
