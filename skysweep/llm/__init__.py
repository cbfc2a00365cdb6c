"""Operators for training-data pipelines on ``documents``, ``embeddings`` and ``pages``."""
