"""Sources and sinks: raw lines, length-delimited protobuf files, the Parquet store."""
