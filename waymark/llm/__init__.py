"""Operators for preparing training text: quality, duplicates, leaks, secrets, models."""
