"""Operators on text corpora: mixing, filtering, deduplication, scoring, extraction, sharding.

Nothing outside this package imports it, apart from ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py``.
"""
