"""quern: evidence retrieval over text corpora, expressed as Spark DataFrame programs."""
