"""docaudit: document auditing on Spark."""
