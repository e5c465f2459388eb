"""Column functions: bytes of payloads, typed values, JSON comparison."""
