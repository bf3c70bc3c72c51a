"""Training-data operators: token counts, media columns, packing, URL rules, archives, decontamination, toxicity, deduplication and language ID.

Nothing else in the library imports this subpackage.
"""
