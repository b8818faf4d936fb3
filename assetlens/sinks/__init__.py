"""Ways out: the three exports."""
