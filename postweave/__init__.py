"""Labelled-post analytics as Spark jobs."""
