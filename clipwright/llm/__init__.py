"""Operators for preparing training corpora: scoring, packing, search, tokenising, archives, privacy, de-duplication.

Nothing outside this subpackage imports it.
"""
