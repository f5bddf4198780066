"""Operators for building training corpora: formatting, dedup, filtering, mixing, packing, output.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries.py`` derives the digest queries from them.
"""
