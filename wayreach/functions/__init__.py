"""Column expressions shared by all operators (no Python functions run per row)."""
