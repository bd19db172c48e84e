"""Standard chains of operators and the queries registered for checking."""
