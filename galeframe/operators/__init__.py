"""Operators of galeframe."""
