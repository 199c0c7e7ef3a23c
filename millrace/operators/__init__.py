"""Relational operators as plain functions on DataFrames."""

from millrace.operators.relational import anti_join, distinct_ordered, group, join, page, residual_join, scan

__all__ = ["anti_join", "distinct_ordered", "group", "join", "page", "residual_join", "scan"]
