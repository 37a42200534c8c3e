"""Text-collation analytics on Spark: comparing many editions of the same text at scale."""
