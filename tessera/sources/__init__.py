"""Where collections come from and go to: given Parquet tables, and versioned snapshots under a manifest."""
