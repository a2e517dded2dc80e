"""Time-ordered sensor and trajectory analytics as Spark DataFrame operations."""
