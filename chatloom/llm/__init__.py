"""Operators of a training-data pipeline: mixing, filters, deduplication, tokens, language-model scores."""
