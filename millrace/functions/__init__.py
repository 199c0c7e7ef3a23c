"""Column functions with the dialect's semantics, built from Catalyst expressions."""

from millrace.functions.expressions import between, divide, equals, first_of_group, int_divide, is_in, like, not_equals

__all__ = ["between", "divide", "equals", "first_of_group", "int_divide", "is_in", "like", "not_equals"]
