"""Operators for large-scale training-data pipelines; no other part of the library imports this subpackage."""
