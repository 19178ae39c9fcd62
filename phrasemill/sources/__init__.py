"""Readers and writers for texts, vectors, descriptors and result tables."""
