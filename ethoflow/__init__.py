"""Track analytics on Spark: movement tracks, zones, episodes, sequences, cohorts and their statistics."""
