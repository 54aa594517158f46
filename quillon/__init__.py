"""Quillon: top-k keyword search over relational data, planned in Python and run by Spark."""
