"""Operators over vector tables: similarity, pruning, subsets, clustering, de-duplication, samples, zero-shot."""
