"""Queries over the driver's tables and the SQL that must give the same rows."""

from tidemark.checks import calendar, changes, copies, details, embedding, pages, scalars, timelines  # noqa: F401
from tidemark.checks.registry import ORACLES, QUERIES  # noqa: F401
