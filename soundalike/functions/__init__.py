"""Column builders: no Python UDFs, everything stays in the JVM."""
