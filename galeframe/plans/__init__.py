"""Plans of galeframe."""
