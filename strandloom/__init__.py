"""Spark-first analytics over positional count signals, sequences and their annotations."""
