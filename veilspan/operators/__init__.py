"""Operators over candidate spans: detection, resolution, replacement, validation."""
