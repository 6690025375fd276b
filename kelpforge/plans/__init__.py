"""Kelpforge plans."""
