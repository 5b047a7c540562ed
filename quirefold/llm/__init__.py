"""Operators that prepare text corpora for model training.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
