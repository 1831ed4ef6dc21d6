"""Trace analytics on Spark DataFrames: spans, links, a small metric language, SQL, lifecycle."""
