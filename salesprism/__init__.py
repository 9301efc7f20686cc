"""Retail sales analytics as lazy Spark DataFrame operators."""
