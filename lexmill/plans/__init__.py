"""Queries over the driver's tables, with their oracles."""
