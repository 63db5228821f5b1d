"""Evidence retrieval and evaluation over text corpora, as Spark jobs."""
