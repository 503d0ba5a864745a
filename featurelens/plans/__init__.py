"""The query catalogue bound to the benchmark tables and its SQL twins."""
