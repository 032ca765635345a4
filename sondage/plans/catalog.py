"""All queries of the engine; importing the modules registers them."""

from . import lexical, scalars, stores  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
