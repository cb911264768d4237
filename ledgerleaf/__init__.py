"""Spark-native processing of form-style documents as tables of typed fields."""
