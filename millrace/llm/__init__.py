"""Operators for preparing language-model training data.

Nothing outside this folder imports it; remove it (with ``tests/llm`` and
``corpus_pipeline.py``) and the rest of the library works unchanged.
"""
