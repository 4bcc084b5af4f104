"""Readers and writers of the dense byte format."""
