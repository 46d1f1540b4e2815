"""Operators: measurement, keyed differences, history, incremental writes, graphs, review analytics and scoring."""
