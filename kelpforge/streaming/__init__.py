"""Kelpforge streaming."""
