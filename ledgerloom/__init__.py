"""A claim ledger on Spark: statements with evidence, on two time axes."""
