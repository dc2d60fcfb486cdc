"""Whole computations: what changed, and what a release is made of."""
