"""Column functions over sequences, the chemistry, and the alignment rescue."""
