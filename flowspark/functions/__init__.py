"""Column functions: they take and return columns and never touch a DataFrame."""
