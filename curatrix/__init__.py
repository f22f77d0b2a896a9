"""Dataset curation and condensation on Spark."""
