"""veldt: an analytics engine for logs of signed events, on Spark DataFrames."""

from .session import get_session

__all__ = ["get_session"]
