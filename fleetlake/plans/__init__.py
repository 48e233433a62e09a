"""Composed queries and the catalog of registered queries."""
