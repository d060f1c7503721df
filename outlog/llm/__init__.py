"""Operators of a training-data pipeline: filters, dedup, mixing, tokenising, scoring, sharding.

Every operator takes and returns DataFrames; ``queries.py`` holds the thin registered queries.
Nothing outside this subpackage imports it except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
