"""Column expressions: text, identity and routing."""
