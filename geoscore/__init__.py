"""Place scoring and daily-weather analytics as PySpark DataFrame operators."""
