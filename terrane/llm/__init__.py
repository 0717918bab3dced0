"""Operators on text corpora and records for language-model training data. Nothing outside imports this package."""
