"""Factweave: analytics over versioned fact graphs on Spark."""
