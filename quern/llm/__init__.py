"""Operators for preparing training corpora: cleaning, deduplication, scanning and layout."""
