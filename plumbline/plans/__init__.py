"""Plumbline plans."""
