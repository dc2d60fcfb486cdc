"""Scalar functions: classification, path rules, codecs, digests."""
