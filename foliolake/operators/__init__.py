"""Transforms over the relations of the document model: DataFrames in, DataFrame out."""
