"""Column functions: time arithmetic, calendar, numeric, text and test statistics."""
