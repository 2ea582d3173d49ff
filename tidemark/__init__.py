"""Profiling, cleaning, validation, repair and scoring of tabular data on Spark."""
