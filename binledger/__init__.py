"""Warehouse stock and order analytics as Spark DataFrame jobs."""
