"""Event-aggregation analytics on Spark: bronze items to typed silver tables to gold read models."""
