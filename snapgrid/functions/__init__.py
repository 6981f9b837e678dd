"""Column expressions: geometry, calendar, text."""
