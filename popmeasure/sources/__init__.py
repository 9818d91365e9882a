"""Readers, writers, schemas, fixed value lists and test-data bindings."""
