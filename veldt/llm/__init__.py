"""Operations for large text corpora: scans, filters, near-duplicates, packing, tokenising.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
