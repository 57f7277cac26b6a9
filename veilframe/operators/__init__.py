"""Operators of the privacy engine."""
