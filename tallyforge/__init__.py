"""tallyforge: an analytics engine expressed as Spark DataFrame, SQL and Structured Streaming plans."""
