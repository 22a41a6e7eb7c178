"""Functions on one value: markup repair and parsing, text analysis, geometry."""
