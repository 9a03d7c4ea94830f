"""Operators for training-data pipelines: dedup, filters, tokenizers, scoring, decontamination."""
