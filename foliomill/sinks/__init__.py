"""Export formats and writers."""
