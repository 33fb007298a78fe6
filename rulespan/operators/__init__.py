"""Relational operators: retrieval, diagnostics, location, catalog, evaluation, vectors and sampling."""
