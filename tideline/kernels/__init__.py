"""Small dense numerics in NumPy, for use inside Arrow groups."""
