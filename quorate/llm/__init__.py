"""Operators of a training-data pipeline: filters, deduplication, decontamination, search, tokens and shards."""
