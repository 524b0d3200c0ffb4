"""Column functions: text analysis, value rendering, bucket hashing."""
