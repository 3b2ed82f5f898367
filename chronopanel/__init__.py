"""Longitudinal policy analytics as Spark DataFrame transformations."""
