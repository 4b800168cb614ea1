"""User-level jobs composed from operators."""
