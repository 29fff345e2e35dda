"""Column functions of the trace model."""
