"""Market-data time-series analytics expressed as Spark DataFrame operators."""

from ticklattice.session import build_session

__all__ = ["build_session"]
