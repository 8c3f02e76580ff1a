"""Filter operators, order keys and cursors as columns."""
