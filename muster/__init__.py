"""Muster: Spark DataFrame and Structured Streaming operators for service-fleet records."""
