"""Batches that commit one by one and resume from a checkpoint."""
