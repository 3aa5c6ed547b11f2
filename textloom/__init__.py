"""textloom: curating and querying text corpora, transcripts and tool traces with Spark DataFrames."""
