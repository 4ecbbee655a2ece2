"""Spark-first analytics over program facts: extraction, matching, ranking, graphs, taint."""
