"""Column functions: text, fingerprints, parsing, names and accounts."""
