"""Training-data operators at corpus scale (deduplication, language ID, packing, secrets).

Nothing else in the library imports this subpackage; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
