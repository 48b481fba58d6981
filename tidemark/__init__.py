"""Spark operators for large, time-stamped collections of items."""
