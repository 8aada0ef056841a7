"""Registered queries over the driver tables, each next to the SQL that checks it."""

from crowdtide.catalog import audit, chat, live, timeline, workflow  # noqa: F401
from crowdtide.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
