"""Structured Streaming variants of core operators."""
