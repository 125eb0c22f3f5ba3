"""Tessella: NumPy- and pandas-flavoured analytics expressed as lazy Spark plans."""

from tessella.session import get_session

__all__ = ["get_session"]
