"""Sources and sinks: Parquet and CSV scans, column checks, series builders, ledgers, generators."""
