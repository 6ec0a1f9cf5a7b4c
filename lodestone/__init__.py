"""Lodestone: architecture analytics on Spark."""
