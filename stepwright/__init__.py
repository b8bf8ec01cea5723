"""Spark engine for step-level preference data."""
