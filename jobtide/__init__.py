"""Batch-job tracking as Spark tables: snapshots in, job state and answers out."""
