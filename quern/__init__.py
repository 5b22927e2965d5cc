"""quern: a document-collection query engine on Spark DataFrames."""
