"""Corpus operators for language-model training data (cleaning, scoring, mixing, indexing).

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
