"""Operators for preparing training data: packing, near-duplicates, token counts, extraction."""
