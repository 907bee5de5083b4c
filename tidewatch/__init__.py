"""Spark jobs that review collections of source files and text as data."""
