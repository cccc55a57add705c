"""Joins, roll-ups, similarity and table changes over articles and stories."""
