"""Readers, schemas and inline dimension tables."""
