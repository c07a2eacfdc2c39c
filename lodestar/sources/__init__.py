"""Sources and sinks: archive records, JSON lines, Parquet parts, and small files in any store."""
