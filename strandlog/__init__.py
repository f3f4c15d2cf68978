"""A PySpark engine for partitioned, append-only event logs."""
