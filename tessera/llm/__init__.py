"""Operators for training-data pipelines: text and page extraction, scoring, near-duplicates, archives, tokens and chat."""
