"""Whole plans: a run over sources, and answers over its results."""
