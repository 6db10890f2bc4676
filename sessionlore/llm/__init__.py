"""Training-data operators: deduplication, scans, filters, mixing, packing, token files.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
