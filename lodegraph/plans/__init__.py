"""Whole plans: fixtures, ingestion, and the registered queries."""
