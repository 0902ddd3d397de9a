"""Scans, bindings and sinks."""
