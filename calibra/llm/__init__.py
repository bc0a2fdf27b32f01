"""Operators for preparing large text corpora. Nothing outside this package imports it."""
