"""Event-sensor analytics as PySpark DataFrame operators."""
