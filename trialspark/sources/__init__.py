"""Readers, writers and the mapping from plain event tables to trial data."""
