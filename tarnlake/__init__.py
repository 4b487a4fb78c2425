"""tarnlake: scan, prune and mutate columnar tables with PySpark."""
