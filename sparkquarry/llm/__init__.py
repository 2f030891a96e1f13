"""Operators for preparing training text at scale. Nothing outside this folder (and corpus_pipeline.py) imports it."""
