"""Encoding plans as columns."""
