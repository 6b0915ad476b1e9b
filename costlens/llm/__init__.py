"""Operators for building training corpora, each usable on its own tables.

Nothing outside this subpackage imports it.
"""
