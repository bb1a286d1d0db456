"""Named queries over the given tables, each beside the SQL it must equal."""

from checks import comprehension, mentions, minutes, pages, search, tables  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
