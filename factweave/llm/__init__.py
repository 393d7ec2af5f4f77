"""Operators for training data: vector neighbours, corpus encoding, packing and language labels."""
