"""Parsers that tell whether source text is valid in its language: Go, Python 3, JavaScript, TypeScript, JSON.

All are recursive-descent parsers for statements with precedence climbing for expressions, over a string in which each
token is one character (its kind). Errors do not end a parse: they are stored and the parser goes on at the next
statement ("panic mode"). Statements of a shape seen before, that is with the same kinds of tokens, are not parsed again:
the shapes that were accepted are kept in a bounded table.
"""

from .base import Errors, check_source, language_of

__all__ = ["Errors", "check_source", "language_of"]
