"""Paired-measurement analytics as Spark DataFrame plans."""
