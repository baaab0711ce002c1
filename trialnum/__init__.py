"""Find, score and evaluate numeric mentions in document tables with Spark."""
