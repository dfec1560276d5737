"""ledgerloom: retail operations analytics as Spark DataFrame jobs."""

from .tables import Tables  # noqa: F401

__version__ = "0.1.0"
