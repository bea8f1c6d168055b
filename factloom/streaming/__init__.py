"""Arrival of fact documents as micro-batches."""
