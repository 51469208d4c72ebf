"""Operators for building training data: scoring, selection, search and near-duplicate detection.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
