"""Readers of text, binary and archived range sets and of reference tables."""
