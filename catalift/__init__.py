"""Spark operators for catalogue migration, governance and batch model scoring."""
