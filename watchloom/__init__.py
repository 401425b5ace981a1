"""Watch-history analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

from watchloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
