"""Column functions: oriented paths, sequences, and small statistics. All run inside the JVM."""
