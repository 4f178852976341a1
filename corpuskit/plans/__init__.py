"""Queries of the core with their SQL counterparts."""
