"""Operators for preparing training data, one module each."""
