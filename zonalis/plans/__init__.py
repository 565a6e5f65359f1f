"""The query catalogue and whole requests."""

from . import more  # noqa: F401  registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
