"""Operators for training data: near-duplicates, validity, encodings, tokens, mixing, look-alikes."""
