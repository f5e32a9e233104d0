"""Operators for building training corpora; nothing else in the package imports this one."""
