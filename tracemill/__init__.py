"""Observability analytics and data processing on Spark."""
