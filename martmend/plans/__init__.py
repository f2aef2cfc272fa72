"""Mart specifications and candidate keys of definition changes."""
