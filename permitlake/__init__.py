"""Purpose-bound retrieval and disclosure audit on Spark."""
