"""Operators of a training-data pipeline: tokens, near copies, licences, toxicity, shards, pages, language models, archives."""
