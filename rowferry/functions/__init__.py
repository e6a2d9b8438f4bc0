"""Column expressions: no UDFs, everything stays inside generated JVM code."""
