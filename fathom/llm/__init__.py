"""Training-data operators.

Nothing else in the library imports this subpackage; it can be removed with
``tests/llm`` and ``corpus_pipeline.py`` and the rest keeps working.
"""
