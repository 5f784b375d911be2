"""Sources and sinks: landed inputs, guarded Parquet reads, materialised tables."""
