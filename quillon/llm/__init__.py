"""Training-data operators: scoring, classification, near duplicates, mixing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
