"""Event analytics on Spark: temporal features, event-time operators, layered serving."""
