"""Operators for preparing training data from large note corpora."""
