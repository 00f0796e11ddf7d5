"""Training-data operators: token counts, token files, near-duplicates, packing, cleaning, decontamination.

Nothing else in the library imports this subpackage; its queries are in :mod:`chartwise.llm.catalogue`.
"""
