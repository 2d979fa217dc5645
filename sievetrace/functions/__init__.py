"""Column functions: text, hashing and features, arithmetic."""
