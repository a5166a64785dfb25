"""All queries of the library, without the optional subpackage."""

from respondex.plans import q_candidates, q_joins, q_response, q_scalar, q_sources, q_store, q_streaming  # noqa: F401
from respondex.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
