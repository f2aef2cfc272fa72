"""Incremental impact and repair of keyed aggregate tables, as Spark jobs."""
