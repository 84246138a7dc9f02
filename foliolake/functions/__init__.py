"""Column functions over text, identifiers and digests."""
