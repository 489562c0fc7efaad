"""Training-data operators: packing, dedup, search, extraction, scoring and tokenisation.

Nothing else in the library imports this subpackage; `queries.py` registers its queries.
"""
