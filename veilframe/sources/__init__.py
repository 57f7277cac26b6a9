"""Sources of the privacy engine."""
