"""Operators for building training corpora. Nothing else in heronry imports this subpackage."""
