"""Readers, writers and upkeep of stored tables."""
