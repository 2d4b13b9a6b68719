"""Relational operators over pages, blocks, sources and runs."""
