"""Column functions: service times, plane geometry, delay distributions."""
