"""Training-data operators: filtering, deduplication, mixing and tokenization of document tables.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
