"""Column expressions. All are built-in Spark SQL functions, so they stay inside code generation."""
