"""corpuskit: DataFrame operators for text and source-code corpora on Spark."""
