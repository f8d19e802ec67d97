"""lexiquarry: text-corpus analytics as plain Spark DataFrame plans."""
