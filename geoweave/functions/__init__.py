"""Column expressions: text, geometry, rules and mailing lines."""
