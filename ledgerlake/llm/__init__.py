"""Operators for preparing training corpora: mixing, packing, deduplication, filtering, search and scoring.

Nothing outside this subpackage imports it.
"""
