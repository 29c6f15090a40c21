"""Plumbline: survey analytics and corpus processing as Spark jobs."""
