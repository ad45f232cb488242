"""Operators of a training-data pipeline: search, language, duplicates, tokens, privacy, toxicity, page text."""
