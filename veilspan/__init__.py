"""Distributed detection, resolution and redaction of personal data in text, built on DataFrames."""
