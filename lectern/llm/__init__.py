"""Training-data operators: formatting, filtering, deduplication, scanning and tokenising.

Nothing else in the library imports this subpackage. ``lectern.llm.queries`` registers its queries.
"""
