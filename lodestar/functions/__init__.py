"""Column expressions, selection and label primitives."""
