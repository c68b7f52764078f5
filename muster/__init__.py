"""Roster pipelines and relational operators on Spark."""
