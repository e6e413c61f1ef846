"""Operators of a language-model training-data pipeline, one module each."""
