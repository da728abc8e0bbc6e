"""Readers, writers and the per-table overview."""
