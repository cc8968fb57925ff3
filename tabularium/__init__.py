"""Labelled-dataset curation and run analytics as Spark jobs."""
