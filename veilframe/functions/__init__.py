"""Functions of the privacy engine."""
