"""Selection-and-histogram analytics on event data, expressed as Spark DataFrame operations."""

__version__ = "0.1.0"
