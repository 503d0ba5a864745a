"""Table loading, nested JSON scans, stage tables and exports."""
