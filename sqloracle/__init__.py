"""DuckDB oracle SQL for the registered queries (correctness gate)."""

from . import analysis, etl, ml, star, whatif  # noqa: F401  (register their SQL)
from .queries import SQL

__all__ = ["SQL"]
