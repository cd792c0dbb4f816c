"""Readers of schema dumps, release lists, manifests and saved state."""
