"""Column functions: no data frames, no actions."""
