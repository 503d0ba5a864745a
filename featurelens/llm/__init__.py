"""Operators for preparing large text collections, and their catalogue queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; the entry
module adds ``featurelens.llm.catalogue`` when the folder is present.
"""
