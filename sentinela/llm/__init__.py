"""Operators for preparing large text corpora for training; see README. Nothing else in the library imports this."""
