"""Kelpforge functions."""
