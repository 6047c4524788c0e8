"""Streaming of galeframe."""
