"""Operators for preparing large text corpora, built on Spark.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
