"""Spark jobs for the data work around schema-managed tables."""
