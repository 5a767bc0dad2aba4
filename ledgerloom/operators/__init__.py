"""Operators of the ledger: DataFrame in, DataFrame out."""
