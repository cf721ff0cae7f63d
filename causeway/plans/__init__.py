"""Composite pipelines, evaluation metrics, gates, and the registered queries."""
