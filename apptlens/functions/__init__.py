"""Column expressions: all built-in, evaluated inside the JVM."""
