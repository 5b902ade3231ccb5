"""lexispark: text, dialogue, graph and series preparation as Spark DataFrame jobs."""
