"""phrasemine: demand mining from large sets of search phrases, as Spark jobs."""
