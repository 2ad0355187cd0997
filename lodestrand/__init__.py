"""Validate, profile, repair and de-duplicate record-oriented sequence text on Spark."""
