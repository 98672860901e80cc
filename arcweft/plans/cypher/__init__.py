"""A strict subset of Cypher over property graphs: tokens, syntax tree, and DataFrame plans."""

from .compile import Result, run
from .parser import QueryRefused, parse

__all__ = ["QueryRefused", "Result", "parse", "run"]
