"""Operators for building large training corpora; nothing else in the package imports this."""
