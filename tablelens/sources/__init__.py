"""Sources and sinks: CSV read / validation / write (Parquet is read with spark.read.parquet)."""
