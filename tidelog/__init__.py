"""tidelog: log analytics as plain PySpark DataFrame and Structured Streaming jobs."""
