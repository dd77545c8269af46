"""Spark-first analytics over relational-database catalogs, statistics and workloads."""
