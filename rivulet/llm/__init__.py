"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it stands alone and can
be removed together with ``corpus_pipeline.py`` and ``tests/llm``.
"""
