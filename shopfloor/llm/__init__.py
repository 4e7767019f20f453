"""Operators for preparing text at training-data scale."""
