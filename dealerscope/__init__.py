"""Dealer sales, receivables, stock and demand analytics as Spark jobs."""
