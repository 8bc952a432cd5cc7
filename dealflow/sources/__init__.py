"""Readers, writers and the views built from the test tables."""
