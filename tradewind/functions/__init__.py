"""Column expressions: arrays, text, catalogue parsing and search terms."""
