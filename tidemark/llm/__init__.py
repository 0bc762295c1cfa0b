"""Operators for preparing training text: dedup, packing, scoring, archives and extraction."""
