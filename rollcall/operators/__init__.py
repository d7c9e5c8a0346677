"""Relation operators: ``DataFrame`` in, ``DataFrame`` out."""
