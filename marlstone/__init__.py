"""Evidence retrieval, decision graphs, evaluation and corpus building as Spark plans."""
