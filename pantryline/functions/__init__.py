"""Column expressions: text rules, versions and dates, nutrients."""
