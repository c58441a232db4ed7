"""Spark-first engine that derives a graded dependency graph from manifests."""
