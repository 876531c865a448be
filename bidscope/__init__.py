"""Procurement analytics as set-based Spark DataFrame jobs."""
