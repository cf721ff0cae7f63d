"""Causeway: event attribution, causal features and evaluation analytics as Spark DataFrame plans."""
