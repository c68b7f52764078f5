"""Sinks: a CSV snapshot and an HTTP dispatcher."""
