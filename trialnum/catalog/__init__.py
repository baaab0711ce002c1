"""Registered queries, the tables they derive from the driver tables, and their SQL oracles."""
