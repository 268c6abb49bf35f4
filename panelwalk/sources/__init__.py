"""Panels built from tables, and file sources and sinks."""
