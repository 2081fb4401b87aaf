"""Document-to-narration analytics on PySpark."""
