"""Column functions: money, text, times, ids. All are built-in Spark expressions."""
