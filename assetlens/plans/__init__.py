"""One register from load to results."""
