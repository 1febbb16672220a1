"""One query per operator over the test tables, each with its SQL oracle."""

from ratelens.queries.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
