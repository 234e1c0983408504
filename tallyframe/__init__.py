"""Inventory analytics on Spark."""
