"""Spark-native engine for measuring what a change to a ledger pipeline does to its numbers."""
