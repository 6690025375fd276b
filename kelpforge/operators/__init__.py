"""Kelpforge operators."""
