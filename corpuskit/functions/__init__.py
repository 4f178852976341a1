"""Column functions (JVM-side first) and the few Arrow functions Spark has no built-in for."""
