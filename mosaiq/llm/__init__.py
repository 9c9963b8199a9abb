"""Corpus preparation for training data: ten operators over whole documents, and their registered queries."""
