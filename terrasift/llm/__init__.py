"""Operators for training-data pipelines: search, decontamination, archives, classifiers, tokens, near-duplicates, URLs, pages."""
