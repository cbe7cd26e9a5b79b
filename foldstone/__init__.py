"""Foldstone: set-at-a-time analytics over log-structured key/value data on Spark.

Every operator is a pure function ``(DataFrame..., literals) -> DataFrame``. Nothing reads the wall
clock: the present is always an argument.
"""

__version__ = "0.1.0"
