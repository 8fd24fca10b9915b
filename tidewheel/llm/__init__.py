"""Operators for training-data corpora: tables of documents, labels and benchmark items."""
