"""Errors that the engine raises."""


class SQLError(Exception):
    """Base of all errors about a statement."""


class ParseError(SQLError):
    """The text is not a statement of the dialect."""


class ExecutionError(SQLError):
    """The statement can't be analysed or run."""


class CompileError(ExecutionError):
    """An expression is ill-typed."""


class CatalogError(SQLError):
    """A table, column or index is missing or already there."""


class TransactionError(SQLError):
    """A transaction verb out of place, or a conflict with another writer."""
