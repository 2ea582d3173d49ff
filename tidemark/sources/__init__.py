"""Readers, writers and the small JSON stores."""
