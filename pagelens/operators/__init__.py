"""Operators on tables of documents: boxes, postings, matches, passages, snippets, sinks."""
