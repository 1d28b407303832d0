"""Column functions. All are built-in expressions, so they stay inside codegen."""
