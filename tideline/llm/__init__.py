"""Operators of a training-data pipeline: scoring, selection, deduplication, decontamination, formatting.

Nothing outside this folder, `corpus_pipeline.py` and `tests/llm` imports it.
"""
