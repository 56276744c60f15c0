"""Shared execution helpers."""
