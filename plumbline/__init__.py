"""plumbline: analytics over tabular data and run records, expressed as Spark plans."""
