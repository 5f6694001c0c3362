"""mobilake.llm: operators on texts and records that a training-data pipeline needs."""
