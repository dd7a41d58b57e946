"""Scalar building blocks as Spark columns."""
