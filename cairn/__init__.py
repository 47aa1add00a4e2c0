"""cairn: content-addressed analytics as composable PySpark jobs."""
