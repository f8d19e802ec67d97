"""Column expressions and the few vectorised UDFs that Spark has no built-in for."""
