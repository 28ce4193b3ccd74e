"""Spark-first analytics for barcoded long reads, with training-data operators in a detachable subpackage."""
