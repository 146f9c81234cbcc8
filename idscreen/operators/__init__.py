"""Batch operators, one module per screening task."""
