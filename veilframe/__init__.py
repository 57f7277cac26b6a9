"""Finding, consolidating and redacting personal data as Spark DataFrame jobs."""
