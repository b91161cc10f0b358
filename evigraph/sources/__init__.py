"""Readers, writers and the views over the star-schema test tables."""
