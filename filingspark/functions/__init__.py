"""Column functions: text, numbers, dates, headcount corrections, casts and soft comparison."""
