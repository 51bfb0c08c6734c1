"""Quarry: analytics operators for effective-dated records, written as Spark DataFrame plans."""
