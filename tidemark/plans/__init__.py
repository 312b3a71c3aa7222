"""Catalog, statements and the registered queries."""
