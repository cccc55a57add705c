"""Refreshes as micro-batches."""
