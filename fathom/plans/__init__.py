"""Pipelines: index, search, answer, status; and the catalogue of queries."""
