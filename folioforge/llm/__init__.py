"""Operators for large training corpora: deduplication, filters, decontamination, archives, tokens and chat formats.

Nothing outside this subpackage imports it; ``folioforge.llm.queries`` holds its registered queries.
"""
