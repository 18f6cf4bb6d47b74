"""Readers, writers and adapters that produce the engine tables."""
