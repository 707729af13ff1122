"""meterflow: measurement-data analytics as plain Spark transformations."""
