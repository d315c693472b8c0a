"""Column functions: text, lexicons, numeric series."""
