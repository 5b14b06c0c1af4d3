"""All queries over the reference tables."""

from . import data_queries, evaluation_queries, panel_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
