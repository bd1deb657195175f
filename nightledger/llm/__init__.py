"""Operators for training-data corpora, on the tables documents, pages, benchmark and labels."""
