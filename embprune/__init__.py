"""Spark jobs over large tables of embedding vectors and the samples behind them."""
