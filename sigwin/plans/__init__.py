"""Composite jobs (the user-level API) and the query registry."""
