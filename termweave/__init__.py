"""Terminology alignment as Spark jobs."""
