"""Provenance-aware analytics as Spark DataFrame, SQL and streaming code."""
