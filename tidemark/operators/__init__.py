"""Writes, changesets and merges, results as entities, and schema evolution."""
