"""The library on a star schema of orders, and on its text tables."""
