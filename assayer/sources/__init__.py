"""Strict table sources."""

from assayer.sources.load import Limits, Loaded, Options, load_table

__all__ = ["Limits", "Loaded", "Options", "load_table"]
