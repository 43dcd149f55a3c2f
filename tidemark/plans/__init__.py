"""Queries: operators composed over the stored tables, with their SQL oracles."""
