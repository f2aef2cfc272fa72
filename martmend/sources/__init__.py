"""Readers, pins and sinks."""
