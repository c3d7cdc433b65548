"""Marlstone: econometrics and time-series analytics as PySpark DataFrame plans."""

__version__ = "0.1.0"
