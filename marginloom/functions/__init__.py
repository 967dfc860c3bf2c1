"""Column expressions. Nothing in this package triggers a job or adds a shuffle."""
