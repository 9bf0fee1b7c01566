"""Readers and sinks."""

from gaugeworks.sources.tables import read_table

__all__ = ["read_table"]
