"""Structured Streaming binding of the goal marts (incremental refresh)."""

from orgpulse.streaming.marts import goal_flags_stream, refresh_marts  # noqa: F401
