"""Column expressions. Everything here is a native Spark expression; there are no Python UDFs."""
