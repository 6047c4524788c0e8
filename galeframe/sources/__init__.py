"""Sources of galeframe."""
