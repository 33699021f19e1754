"""Readers and writers of slide containers."""
