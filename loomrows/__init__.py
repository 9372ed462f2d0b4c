"""Row pattern recognition and training-data operators on PySpark."""

from .api import formatted, match_recognize, run_clause
from .plans.ast import QueryError

__all__ = ["QueryError", "formatted", "match_recognize", "run_clause"]
