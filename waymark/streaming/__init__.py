"""Structured Streaming forms of two batch ideas: windowed delays and per-journey running state."""

from .delays import delay_windows, running_delay  # noqa: F401
