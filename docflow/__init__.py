"""docflow: office documents, web pages and training corpora as Spark DataFrames."""
