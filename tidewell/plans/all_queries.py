"""All queries of the library, once their modules are imported."""

from . import access, history, listing_query, market, pages, quality, selection, sources, spatial, streams, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
