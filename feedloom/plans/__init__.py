"""Declarative stage chains and the registered query catalog."""
