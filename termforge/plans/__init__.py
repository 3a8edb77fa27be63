"""Whole plans: query parsing, the search engine, the query catalogue."""
