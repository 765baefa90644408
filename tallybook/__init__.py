"""Accounting analytics for money movement, written as Spark DataFrame plans."""
