"""Operators on lines, records and findings."""
