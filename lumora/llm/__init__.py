"""Training-data operators: deduplication, filtering, scoring, packing and file formats.

Each module holds one operator with a general interface; ``queries`` applies each of them
to its whole table. Nothing outside this subpackage imports it.
"""
