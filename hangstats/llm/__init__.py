"""Operators for preparing training text, as Spark jobs over a table of documents."""
