"""Operators for preparing large training corpora. Nothing else in tidelog imports this."""
