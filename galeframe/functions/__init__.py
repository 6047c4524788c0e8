"""Functions of galeframe."""
