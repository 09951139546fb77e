"""Compiles corpora of Markdown and JSON Schema into compact lines, as Spark plans."""
