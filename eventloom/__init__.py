"""Event-study and text-feature analytics as Spark DataFrame operators."""
