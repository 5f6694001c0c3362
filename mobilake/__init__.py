"""mobilake: a Spark-first engine for urban sensor, mobility and event data."""
