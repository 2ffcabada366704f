"""Evidence retrieval, evaluation and corpus processing as Spark DataFrame plans."""
