"""Gapped k-mer sequence analytics on Spark."""
