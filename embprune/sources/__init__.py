"""Readers and writers: vector tables, chunk files, tar shards, working tables."""
