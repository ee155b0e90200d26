"""Relational and per-image operators."""
