"""Search, graph and findings analytics over text and code corpora, declared on Spark DataFrames."""
