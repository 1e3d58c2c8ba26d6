"""Operators of a training-data pipeline: quality, scores, tokens, pages, mixing, secrets, copies."""
