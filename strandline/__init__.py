"""Positional sequence analytics expressed as lazy Spark DataFrame operators."""
