"""quire: a Spark-first engine for document content, its evaluation and its corpora."""
