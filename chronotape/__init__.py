"""Point-in-time market research as PySpark DataFrame jobs."""

__version__ = "0.1.0"
