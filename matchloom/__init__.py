"""Exact multi-pattern matching over text tables, and analysis of the runs that produce the matches, on Spark."""
