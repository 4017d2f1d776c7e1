"""Operators of a large-scale training-data pipeline, on DataFrames.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
