"""telemill: security-telemetry analytics as plain Spark DataFrame operators."""
