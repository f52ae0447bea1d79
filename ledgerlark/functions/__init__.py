"""Column functions: text kernels, normalisers, calendar and statistics."""
