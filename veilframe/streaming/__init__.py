"""Streaming of the privacy engine."""
