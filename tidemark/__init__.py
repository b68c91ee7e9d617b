"""Event-time stream matching and relational analytics on Spark."""

__version__ = "0.1.0"
