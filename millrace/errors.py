"""Errors raised by the front end, the loader and the transaction layer."""


class EngineError(Exception):
    """Base of all errors that this package raises itself."""


class ParseError(EngineError):
    """The text is not a statement of the dialect; ``position`` points at the fault."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message)
        self.position = position


class TypeMismatch(EngineError):
    """A string is compared with a number, or a loaded value has the wrong type."""


class MalformedData(EngineError):
    """A delimited line has the wrong number of fields."""


class DuplicateTable(EngineError):
    pass


class NoSuchTable(EngineError):
    pass


class IllegalOperation(EngineError):
    """The dialect has no such operation (cross product, theta join, column lists in INSERT, ...)."""


class IllegalTransaction(EngineError):
    """COMMIT or ROLLBACK without BEGIN, BEGIN inside a transaction, or use after the end."""


class TransactionConflict(EngineError):
    """Another transaction committed first; start over."""
