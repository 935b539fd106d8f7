"""Column functions: one row in, one value out, all inside the JVM."""
