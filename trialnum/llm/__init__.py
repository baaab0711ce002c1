"""Operators for training-data pipelines. Nothing outside this folder, its tests and corpus_pipeline.py imports it."""
