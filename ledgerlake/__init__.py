"""Catalog, change-history and evidence analytics as Spark DataFrame operators."""
