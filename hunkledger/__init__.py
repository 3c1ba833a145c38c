"""Change scanning and audit analytics over tables of unified diffs, on Spark."""

__version__ = "0.1.0"
