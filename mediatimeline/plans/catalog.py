"""All registered queries."""

from mediatimeline.plans import change, documents, files, frames, intervals, library, rollups, rows, scenes, streams  # noqa: F401
from mediatimeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
