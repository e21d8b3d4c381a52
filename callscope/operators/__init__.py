"""Operators over packets, signalling, calls and reports."""
