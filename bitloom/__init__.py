"""Parallel-text preparation and evaluation as Spark DataFrame operators."""
