"""Plumbline streaming."""
