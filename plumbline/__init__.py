"""Plumbline: table profiling, diagnosis, feature work and run analytics as Spark jobs."""
