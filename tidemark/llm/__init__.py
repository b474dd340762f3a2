"""Training-data operators: cleaning, near-duplicate joins, scoring, mixing and packing.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
