"""All queries and their SQL twins."""

from . import benchmark, clocks, features, inference, nested, platform, replay, reports, simulation, studies  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
