"""Star-schema analytics as PySpark DataFrame operators."""
