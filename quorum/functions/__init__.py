"""Column functions: hashes, text rules, distributions."""
