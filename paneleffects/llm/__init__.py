"""Operators for preparing training data for language models.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
