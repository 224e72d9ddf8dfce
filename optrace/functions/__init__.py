"""Column functions: no shuffles, no Python on the workers."""
