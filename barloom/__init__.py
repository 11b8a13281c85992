"""Market-data analytics as plain DataFrame operators for Spark."""
