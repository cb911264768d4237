"""Transformations of form tables: DataFrame to DataFrame."""
