"""Spreadsheet calculation semantics over distributed tables, as DataFrame operators."""

__version__ = "0.1.0"
