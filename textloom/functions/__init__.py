"""Column expressions: pure functions from columns to columns, all inside Spark's code generation."""
