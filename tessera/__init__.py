"""Leakage-safe dataset preparation and evaluation, expressed as Spark DataFrame plans."""
