"""Column functions: JSON access, stacks, duration histograms."""
