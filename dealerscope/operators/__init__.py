"""Reusable DataFrame transformations: filters, roll-ups, ranks, quality checks."""
