"""Spark jobs for knowledge, memory and training data."""
