"""Training-data operators: token counts, quality, near duplicates, PII, packing, mixing.

Nothing else in the library imports this package; ``catalog`` registers its
queries. Each operator is a function of DataFrames with a general interface;
the ``opN_*`` queries in ``catalog`` only choose its inputs and digest columns.
"""
