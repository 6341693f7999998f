"""Training-data operators: deduplication, decontamination, scoring and packing.

Nothing outside this subpackage imports it.
"""
