"""Catalog routing and evidence analytics as Spark DataFrame operators."""
