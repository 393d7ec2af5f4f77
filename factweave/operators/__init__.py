"""Operators over versions, entries, metadata and change feeds."""
