"""All drainage queries: name -> fn(spark, sf_dir), and the SQL that checks them."""

from . import cleaning, documents, drains, emission, feeds, graphs, hydraulics, spatials, streets, waters  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
