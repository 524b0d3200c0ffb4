"""Index stores and readers of corpora, queries and judgements."""
