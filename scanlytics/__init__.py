"""Spark DataFrame operators for scan corpora, event logs and training text."""
