"""Metric and event queries on Spark."""

from .api import Engine, Prepared, error_string

__all__ = ["Engine", "Prepared", "error_string"]
