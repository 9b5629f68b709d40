"""What can go wrong, by class; all are WeftError. Errors of reading and writing are OSError, as Python has them."""

from __future__ import annotations


class WeftError(Exception):
    pass


class ParseError(WeftError):
    """A source file that is not UTF-8."""


class QueryError(WeftError, ValueError):
    """A question that can't be answered: an unknown or ambiguous name, a missing argument."""


class RenderError(WeftError, RuntimeError):
    """A drawing that can't be made."""
