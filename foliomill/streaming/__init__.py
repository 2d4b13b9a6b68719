"""Incremental restoration: finished units are committed as they come, and never done twice."""
