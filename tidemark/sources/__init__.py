"""Readers, writers and the manifest."""
