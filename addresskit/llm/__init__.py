"""Operators of a training-data pipeline: fingerprints, near-duplicate joins, filters, language models and mixing."""
