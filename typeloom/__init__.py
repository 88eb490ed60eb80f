"""Typed, composable data transformations on Spark."""
