"""Operators for training corpora; no other part of the library imports this subpackage."""
