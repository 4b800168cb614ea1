"""Data frame operators."""
