"""Column functions: text, values, JSON, dates and hashes."""
