"""Readers, writers and the adapters that derive graph inputs from star-schema tables."""
