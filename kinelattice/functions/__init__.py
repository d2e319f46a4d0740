"""Column functions: vectors, geometry, missing values."""
