"""Sequence models, matrix models and simulations."""
