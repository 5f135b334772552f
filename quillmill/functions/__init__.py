"""Column expressions: text, dates, JSON records and statistics."""
