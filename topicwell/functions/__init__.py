"""Column expressions: endpoint rule, JSON bodies and payloads."""
