"""Loads every family of queries into one registry."""

from . import sqlbase  # noqa: F401
from . import cleaning  # noqa: F401
from . import evidence  # noqa: F401
from . import ops  # noqa: F401
from . import search  # noqa: F401
from . import evaluation  # noqa: F401
from . import ingest  # noqa: F401
from . import files  # noqa: F401
from . import streams  # noqa: F401
from .registry import QUERIES, expand

__all__ = ["QUERIES", "expand"]
