"""Training-data operators: dedup, scoring, token counts, packing, tokenising, media.

Nothing else in the library imports this subpackage.
"""
