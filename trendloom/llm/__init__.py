"""Training-data operators: filtering, deduplication, scanning, encoding and packing of text corpora.

Nothing outside this subpackage imports it.
"""
