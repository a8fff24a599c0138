"""Operators on DataFrames: signals, joins, divergences, reads, imputation, sampling."""
