"""Named queries over the driver's tables and the SQL each of them must equal."""

from __future__ import annotations

from galeframe.plans import aggregates, inference, joins, learning, metrics, scalars, series, storage, studies  # noqa: F401  they register their queries
from galeframe.plans.registry import ORACLES, QUERIES

FLAGSHIP = "W8_episodes"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
