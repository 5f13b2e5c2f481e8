"""Operators that large-scale training-data pipelines need; nothing else in the library imports this subpackage."""
