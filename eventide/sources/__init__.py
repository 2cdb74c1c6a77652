"""Readers, sinks and the mapping of supplied tables to sequences."""
