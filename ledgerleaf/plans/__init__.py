"""Whole jobs: the twelve tools, and the queries over tables that stand in for forms."""
