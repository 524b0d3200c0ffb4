"""Extension: feeding an index from a stream."""
