"""Session-record analytics on Spark."""
