"""Repositories on storage, their transactions, and the catalogue of queries."""
