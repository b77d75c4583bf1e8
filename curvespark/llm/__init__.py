"""Operators for preparing training data: de-duplication, filtering, formatting, archives and tokens."""
