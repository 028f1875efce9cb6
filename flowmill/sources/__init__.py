"""Scans, file tables, registries and sinks."""
