"""Expense analytics and training-data operators for PySpark."""
