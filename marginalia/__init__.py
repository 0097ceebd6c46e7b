"""Queries over, and changes to, large collections of tagged Markdown notes on Spark."""

from marginalia import functions, operators, schema, sources, streaming

__all__ = ["functions", "operators", "schema", "sources", "streaming"]
