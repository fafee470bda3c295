"""Catalogue, event readers and flat-table sinks."""
