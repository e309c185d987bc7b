"""Readers and writers for annotation, manifest and clip tables."""
