"""Operators for preparing language-model training data; nothing else in loam imports them."""
