"""corpuslab: prepare, profile and classify text corpora with Spark DataFrames."""
