"""Readers and writers of fact documents, snapshots and logs."""
