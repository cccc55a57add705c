"""Operators for preparing training text at scale.

Nothing outside this folder imports it, apart from ``corpus_pipeline.py`` and the
guarded registration in ``__spark_entry__.py``.
"""
