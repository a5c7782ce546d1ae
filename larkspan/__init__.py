"""Analytics, scoring and streaming jobs written as plain Spark DataFrame code."""
