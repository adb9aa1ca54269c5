"""A PySpark engine that mines captured text artifacts for structured findings."""
