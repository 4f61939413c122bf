"""Tallyspring: driver-based time-series analytics and data preparation on PySpark."""
