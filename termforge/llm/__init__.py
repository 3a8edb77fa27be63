"""Operators for preparing language-model training data.

Nothing outside this subpackage (and ``corpus_pipeline.py``, its driver script)
imports it, so the folder can be removed without touching the search engine.
"""
