"""Column functions: text, paths, identifiers and hashes."""
