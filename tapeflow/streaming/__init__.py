"""Structured Streaming forms of the order-book and bar operators."""
