"""Spark-first entity linking, text analytics and evaluation."""
