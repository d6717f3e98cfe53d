"""Operators for language-model data; nothing else in the package imports them."""
