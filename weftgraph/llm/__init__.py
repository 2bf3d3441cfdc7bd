"""Operators for corpora that train language models."""
