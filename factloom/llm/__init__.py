"""Operators for training data: near duplicates, survivors, packing, leakage and shared spans."""
