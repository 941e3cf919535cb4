"""Attributes that keep arriving."""
