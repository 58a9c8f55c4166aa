"""Declarative views over nested records, on Spark."""
