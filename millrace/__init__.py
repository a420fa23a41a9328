"""millrace: a small relational engine expressed as Spark plans."""

from millrace.engine import Connection, Engine, QueryType, Result
from millrace.errors import EngineError
from millrace.session import get_session

__all__ = ["Connection", "Engine", "EngineError", "QueryType", "Result", "get_session"]
