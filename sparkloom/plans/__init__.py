"""The library's plans."""
