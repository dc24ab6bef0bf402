"""Training-data operators: dedup, scoring, decontamination, packing, formatting.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries, every other module one operator with its own general interface.
"""
