"""Operators for training-data pipelines: near-duplicates, filters, tokens, packing, chat."""
