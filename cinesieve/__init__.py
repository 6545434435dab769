"""Curation of ordered frame collections on Spark."""
