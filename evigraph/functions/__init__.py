"""Column functions: everything here is a native expression and stays in the JVM."""
