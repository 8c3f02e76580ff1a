"""Results that are kept up to date from batches of changes, and pages of results."""
