"""Column expressions (JVM side) and the small numpy helpers behind the pandas UDFs."""
