"""tramline: urban-mobility analytics as lazy PySpark DataFrame operations."""

__version__ = "0.1.0"
