"""Tidemark: event-telemetry analytics as declarative Spark plans."""
