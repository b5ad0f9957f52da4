"""Review-evidence analytics as Spark jobs: ingest, clean, validate, search, meter and evaluate."""

from .session import get_session, tune

__all__ = ["get_session", "tune"]
