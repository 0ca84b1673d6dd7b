"""Retail analytics as plain Spark DataFrame operators."""
