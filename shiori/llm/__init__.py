"""Operators for preparing training data: splitting, one visible form, term counts, nearest vectors, packing, mixing, spam."""
