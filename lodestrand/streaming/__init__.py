"""Runs over files as they arrive."""
