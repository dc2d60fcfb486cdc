"""Operators on assets, blocks and segments."""
