"""See the package docstring in tarnline/__init__.py."""
