"""Training-data operators: sharding, packing, PII, BPE, LM scoring, quality, dedup, licences, URLs.

Nothing else in the library imports this subpackage.  `queries.py` holds the
registered `opN_<name>` queries.
"""
