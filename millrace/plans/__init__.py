"""From SQL text to a DataFrame: lexer and parser, scopes and types, lowering, EXPLAIN."""

from millrace.plans.parser import parse, parse_script

__all__ = ["parse", "parse_script"]
