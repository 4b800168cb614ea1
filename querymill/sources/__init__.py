"""Reading queries, pages and stored results; writing stored results."""
