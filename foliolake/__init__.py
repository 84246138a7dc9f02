"""Corpus analytics for structured documents, expressed as Spark DataFrames."""
