"""rulespark: rule engines for text and JSON, compiled to Spark plans."""
