"""All queries of the engine: importing the modules registers them."""

from . import composed, configured, core, drawn, embedded, rendered, sampled, service  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
