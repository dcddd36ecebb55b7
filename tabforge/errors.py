"""Exceptions raised by operators; each names the offending columns or counts."""


class TabforgeError(Exception):
    """Base class."""


class DataError(TabforgeError):
    """The input table violates an operator's contract (types, nulls, classes, rows)."""


class ParamError(TabforgeError):
    """An operator argument is invalid (unknown strategy, bad grid, short rationale)."""
