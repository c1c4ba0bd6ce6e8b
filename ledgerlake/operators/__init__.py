"""Operators: DataFrame -> DataFrame functions over catalogs, event logs, evidence and grids."""
