"""Readers of the engine's tables."""
