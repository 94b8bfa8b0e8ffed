"""Recommendation analytics over user-item interaction logs, written for Spark."""
