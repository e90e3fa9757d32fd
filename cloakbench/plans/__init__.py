"""All queries of the library and their SQL."""

from . import detectors, generation  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
