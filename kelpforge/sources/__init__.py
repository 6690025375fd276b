"""Kelpforge sources."""
