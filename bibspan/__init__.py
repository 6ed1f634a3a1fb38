"""Bibliographic coverage and citation analytics as Spark DataFrame jobs."""
