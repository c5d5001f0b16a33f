"""The loan portfolio: its tables, its graph and the questions asked of it."""
