"""Operators for preparing training text: fixity, near duplicates, packing,
quality, secrets, token counts, decontamination, extraction and token files.

Nothing else in the library imports this subpackage.
"""
