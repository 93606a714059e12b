"""Operators for large training-data pipelines, each an independent module."""
