"""Operators for the preparation of language-model training data, and their registered queries."""
