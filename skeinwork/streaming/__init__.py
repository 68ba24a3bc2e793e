"""Streams into the engine's tables."""
