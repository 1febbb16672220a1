"""Column-to-column expressions. All run inside the JVM."""
