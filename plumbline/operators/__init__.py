"""Plumbline operators."""
