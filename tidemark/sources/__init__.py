"""Collections from Parquet folders, DataFrames in memory, and snapshots."""
