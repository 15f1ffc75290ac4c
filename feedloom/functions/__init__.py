"""Column -> Column scalar functions (all JVM-side built-ins)."""
