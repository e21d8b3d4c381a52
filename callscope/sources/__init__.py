"""Capture-file source and media sinks."""
