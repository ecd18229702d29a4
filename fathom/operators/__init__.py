"""Relational operators: search, fusion, graph, hierarchy, store."""
