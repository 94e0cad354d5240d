"""Column expressions shared by all operators (JVM side only, no UDFs)."""
