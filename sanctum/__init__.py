"""Text sanitisation and audit on Spark."""
